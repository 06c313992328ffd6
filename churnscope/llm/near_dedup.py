"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct word shingles (hashed to 64 bits).  Equal
sets form one class, and only classes are compared.  Each class has a MinHash
signature of ``COORDINATES`` values and is posted under its (coordinate,
value) pairs.  At the production similarity 0.8 two sets agree on a
coordinate with probability 0.8, so fewer than ``MATCHES`` of 64 agree with
probability 2e-8; pairs below that count are no candidates.

* Prefix: two signatures that agree on ``MATCHES`` of 64 coordinates share one
  of the ``64 - MATCHES + 1`` rarest pairs of either.  Pairs that one class
  alone has cannot collide, so a class with that many of them posts nothing,
  and the others post only the rest of their prefix.
* Skip: in each posting list every class is first compared with one hub (the
  one whose pairs are most common), which is linear in the list.  Confirmed
  links are merged into components, and pairs within one are skipped.  Pairs of
  different components are looked at where one side does not agree with the
  hub.  Where both do, their sets relative to the hub tell what they can share:
  a pair is a candidate if both have enough of the hub's shingles, or if they
  meet in the prefix of the shingles that the hub has not.  A family of
  thousands of near copies costs its size and its strays, not its square,
  while every link that could join two components is looked at.
* Candidates whose signatures agree on ``MATCHES`` coordinates are confirmed on
  their full sets, and components follow from confirmed links alone.

Work is keyed by posting pair, by pair of classes or by class; none of the
steps gathers a list or a component in one task.  Joins sort both sides
(``SORTED``); only a counted table of ids is broadcast (``BROADCAST_ROWS``).

Edge cases: a text with fewer words than a shingle has its whole word
sequence as its one shingle; without words (null, empty, blank) the set is
empty and linked with nothing.  Rows are the nodes: repeated rows, also with
the same id, share a class; ids name the components, whose id is their
smallest (null only if no member has one).  An empty table gives an empty
result; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.components import components
from churnscope.llm.textblock import SPACED, blocks, buffer_of, split_words, trim
from churnscope.session import SORTED, release, stash

SHINGLE = 5
SIMILARITY = (80, 100)  # intersection * 100 >= 80 * union
COORDINATES = 64
MATCHES = 32
SEED = 20_011
#: How often families are moved around better hubs, at most; what then is left is posted all the same.
RECENTRED = 3
#: Ids (8 bytes each) of candidates that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, where each text begins)."""
    words = split_words(column, SPACED)
    term = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in words.terms.to_pylist()),
                       np.uint64, len(words.terms))
    h = _mix(term)[words.codes] if len(term) else np.zeros(0, np.uint64)
    counts = np.diff(words.offsets)
    n_shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(n_shingles)))
    owner = np.repeat(np.arange(len(counts)), n_shingles)
    begin = words.offsets[owner] + np.arange(len(owner)) - offsets[owner]
    width = np.minimum(counts, size)[owner]
    value = width.astype(np.uint64)
    for k in range(size):  # shorter texts end before the last words
        some = k < width
        value = np.where(some, _mix(value * np.uint64(0x9E3779B97F4A7C15)
                                    + h[np.where(some, begin + k, 0)]), value) if len(h) else value
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Per text one 32-bit value for each coordinate (texts without shingles: 0)."""
    out = np.zeros((len(offsets) - 1, coordinates), np.uint32)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (coordinates, 2), dtype=np.uint64)
    for j in range(coordinates if len(full) else 0):
        hashed = (values ^ draw[j, 0]) * (draw[j, 1] * np.uint64(2) + np.uint64(1))
        out[full, j] = np.minimum.reduceat(hashed, offsets[:-1][full]).astype(np.uint32)
    return out


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set, null if empty), signature, its low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            values, offsets = shingle_sets(block.column(1), shingle)
            sig = signatures(values, offsets)
            keys = [_digest(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * sig.shape[1]),
                                            pa.array(sig.ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(np.diff(offsets)), pa.array(keys, pa.binary()), flat,
                 pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary()), *block.columns[2:]],
                ["doc_id", "n_shingles", "key", "sig", "low", *kept])
        trim()

    kept = docs.columns[2:]
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(run, f"doc_id long, n_shingles long, key binary, sig array<int>, low binary{more}")


def _sets_of(used: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(cls, values): the full set of each class in ``used``, from one document of it."""
    used = stash(classes.join(used.hint(SORTED), "cls", "left_semi").select(
        "cls", "key", F.col("one.doc_id").alias("_id"), F.col("one.tag").alias("_tag")), "near-used")
    rows = F.broadcast(used) if used.count() <= BROADCAST_ROWS else used.hint(SORTED)  # else the texts are shuffled
    texts = docs.select("doc_id", "text", _tag("text").alias("tag")).join(
        rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))).select(
        "cls", "text", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            values, offsets = shingle_sets(block.column(1), shingle)
            keys = pa.array([_digest(values[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                             pa.array(values.view(np.int64)))
            same = pa.compute.equal(keys, block.column(2))
            yield pa.RecordBatch.from_arrays([block.column(0).filter(same), lists.filter(same)],
                                             ["cls", "values"])
        trim()

    sets = stash(texts.mapInArrow(run, "cls long, values array<long>"), "near-sets")
    release(used)
    return sets


def _tag(text: str) -> F.Column:
    return F.xxhash64(text)


def _agreeing(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Distinct pairs (a, b) whose signatures agree on enough coordinates, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (buffer_of(batch.column(i))[1].reshape(batch.num_rows, COORDINATES) for i in (2, 3))
            hit = pa.array((one == two).sum(axis=1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)],
                                             ["a", "b"])

    both = (pairs.select("a", "b").distinct()
            .join(classes.select(F.col("cls").alias("a"), F.col("low").alias("low_a")).hint(SORTED), "a")
            .join(classes.select(F.col("cls").alias("b"), F.col("low").alias("low_b")).hint(SORTED), "b"))
    return stash(both.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long"), "near-pairs")


def _compared(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs with their full sets compared, as a written table: ``common`` shingles, whether they
    are ``linked``, and the shingles ``own`` that a has and b has not."""
    part, whole = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, linked, own = [], [], []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = one.values.to_numpy(), two.values.to_numpy()
                shared = np.isin(x, y, assume_unique=True)
                both = int(shared.sum())
                common.append(both)
                linked.append(whole * both >= part * (len(x) + len(y) - both))
                own.append(x[~shared])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_()),
                 pa.array(own, pa.list_(pa.int64()))], ["a", "b", "common", "linked", "own"])

    joined = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("values").alias("one")).hint(SORTED), "a")
              .join(sets.select(F.col("cls").alias("b"), F.col("values").alias("two")).hint(SORTED), "b"))
    return stash(joined.select("a", "b", "one", "two").mapInArrow(
        run, "a long, b long, common long, linked boolean, own array<long>"), "near-compared")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` has more than one ``root``, with the smallest ``n`` of the key."""
    groups = rows.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least_n"))
    return rows.join(stash(groups.where("low <> high").select(key, "least_n"), "mixed").hint(SORTED), key)


def _recentred(family: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame] | None:
    """(family, links): families whose members share more with one of them than with the hub, around that one.

    A member's own shingles count once for each member that has them, the hub's as often as members have them on
    average.  Every member is compared with the new hub, one pair a member.  None if no family has a better hub.
    """
    own = family.select("b", "cls", F.explode("own").alias("value"))
    often = own.groupBy("b", "value").agg(F.count("*").alias("k")).where("k > 1")
    shares = own.join(often.hint(SORTED), ["b", "value"]).groupBy("b", "cls").agg(F.sum("k").alias("gain"))
    whole = family.groupBy("b").agg(F.sum("common").alias("merit"), F.max("common").alias("n_hub"))
    likely = F.col("gain") + F.col("common") * F.col("merit") / F.col("n_hub")
    found = family.select("b", "cls", "common").join(shares.hint(SORTED), ["b", "cls"]).join(
        whole.hint(SORTED), "b").where(
        likely > F.col("merit")).groupBy("b").agg(F.max(F.struct(likely.alias("likely"), "cls")).alias("best"))
    hubs = stash(found.select("b", F.col("best.cls").alias("c")), "new-hubs")
    if not hubs.take(1):
        release(hubs)
        return None
    moved = stash(family.select("b", "cls", "n").join(hubs.hint(SORTED), "b"), "moved")
    pairs = moved.where("cls <> c").select(F.col("cls").alias("a"), F.col("c").alias("b")).distinct()
    near = _compared(pairs, sets, similarity)
    known = near.select(F.col("a").alias("cls"), F.col("b").alias("c"), "common", "own")
    around = moved.join(known.hint(SORTED), ["cls", "c"], "left").select(
        "b", "cls", F.coalesce("common", "n").alias("common"),
        F.coalesce("own", F.array().cast("array<long>")).alias("own"), "n")  # the new hub has all of itself
    rest = family.join(hubs.hint(SORTED), "b", "left_anti").select("b", "cls", "common", "own", "n")
    out = stash(rest.unionByName(around), "families")
    release(hubs, moved)
    return out, near


def near_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY,
                matches: int = MATCHES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept, and columns ``carry``."""
    if not 0 < matches <= COORDINATES:
        raise ValueError(f"matches must be 1 to {COORDINATES}")
    part, whole = similarity
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"),
                     F.col(text_column).cast("string").alias("text"), *carry)
    rows = stash(sketch(docs.select("doc_id", "text", _tag("text").alias("tag"),
                                    *[F.col(c).alias(f"carry_{c}") for c in carry]), shingle), "sketches")
    # classes of equal sets; their numbers are drawn once, when the table is written
    classes = stash(rows.where(F.col("key").isNotNull()).groupBy("key")
                    .agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tag")).alias("one"),
                         F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"))
                    .withColumn("cls", F.monotonically_increasing_id()), "classes")

    # posting pairs that several classes have, and each class's prefix of them
    tokens = classes.select("cls", F.posexplode("sig").alias("c", "v")).select(
        "cls", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n_token")).where("n_token > 1")
    prefix = COORDINATES - matches + 1
    chosen = (tokens.join(shared.hint(SORTED), "token").groupBy("cls")
              .agg(F.sort_array(F.collect_list(F.struct("n_token", "token"))).alias("some"))
              .withColumn("room", F.size("some") - (COORDINATES - prefix)).where("room > 0")
              .select("cls", F.expr("transform(slice(some, 1, room), x -> x.token)").alias("tokens"),
                      F.expr("aggregate(some, 0L, (s, x) -> s + x.n_token)").alias("weight")))
    posts = stash(chosen.join(classes.select("cls", "n").hint(SORTED), "cls"), "posts")

    # every class of a posting list against one hub of it, the one that shares most
    posted = posts.select("cls", "n", "weight", F.explode("tokens").alias("token"))
    hubs = stash(posted.groupBy("token").agg(F.max(F.struct("weight", "cls", "n")).alias("hub"),
                                             F.count("*").alias("k"))
                 .where("k > 1").select("token", F.col("hub.cls").alias("b"), F.col("hub.n").alias("n_b")), "hubs")
    star = posted.join(hubs.hint(SORTED), "token").where(F.col("cls") != F.col("b"))
    pairs = _agreeing(star.select(F.col("cls").alias("a"), "b"), classes, matches)
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), classes, docs, shingle)
    near = _compared(pairs, sets, similarity)
    release(pairs)
    links = near.where("linked").select("a", "b")
    roots = stash(components(links), "near-roots")

    # what is left are pairs of different components in one list
    def named(df: DataFrame) -> DataFrame:
        return df.join(roots.withColumnRenamed("node", "cls").hint(SORTED), "cls", "left").withColumn(
            "root", F.coalesce("root", "cls"))

    def sides(df: DataFrame, key: list[str], *columns: str) -> list[DataFrame]:
        return [df.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "root", *columns)]) for x in "ab"]

    apart = ((F.col("root_a") != F.col("root_b"))
             & (F.col("n_a") * whole >= F.col("n_b") * part) & (F.col("n_b") * whole >= F.col("n_a") * part))
    ordered = F.col("cls_a") < F.col("cls_b")

    # of which one does not agree with the hub: collisions are counted as the pairs meet
    known = near.select(F.col("a").alias("cls"), "b", F.lit(True).alias("known"))
    lists = _mixed(named(posted.join(hubs.hint(SORTED), "token")), "token").join(
        known.hint(SORTED), ["cls", "b"], "left").withColumn(
        "known", F.coalesce("known", F.col("cls") == F.col("b")))
    lists = stash(lists.join(classes.select("cls", "sig").hint(SORTED), "cls").select(
        "token", "cls", "n", "root", "known", "sig"), "mixed-lists")
    one, two = sides(lists, ["token"], "known", "sig")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    loose = one.where("NOT known_a").join(two.hint(SORTED), "token").where(
        apart & (F.col("known_b") | ordered) & (same >= matches))

    # or of which both do: the family of a hub.  Families that have a better hub are moved around it, which
    # also finds links; all members stay compared with the one hub of their family
    family = near.select(F.col("a").alias("cls"), "b", "common", "own").join(
        classes.select("cls", "n").hint(SORTED), "cls")
    heads = family.select("b").distinct().join(
        classes.select(F.col("cls").alias("b"), "n").hint(SORTED), "b").select(
        F.col("b").alias("cls"), "b", F.col("n").alias("common"), F.array().cast("array<long>").alias("own"), "n")
    member = ["b", "cls", "common", "own", "n"]
    family = stash(_mixed(named(family.unionByName(heads)), "b").select(*member), "families")
    moves = []
    for _ in range(RECENTRED):
        moved = _recentred(family, sets, similarity)
        if moved is None:
            break
        release(family, roots)
        family, found = moved
        moves.append(found)
        links = links.union(found.where("linked").select("a", "b"))
        roots = stash(components(links), "near-roots")
    release(sets)

    # similar sets share part / (part + whole) of their sizes, within the hub's set or in shingles outside it.
    # These are posted rarest first, and of two lists that must share t entries one is among the first of
    # either, all but t - 1.  The least t of a member follows from its size and the least one in its family
    family = _mixed(named(family), "b")
    largest = family.groupBy("b").agg(F.max(F.struct("common", "cls", "root")).alias("h")).select(
        "b", F.col("h.root").alias("head"))
    family = stash(family.join(largest.hint(SORTED), "b").withColumn("stray", F.col("root") != F.col("head")), "mixed-families")
    # two components in a family: one of them is not the hub's
    stray = ~F.col("stray_b") | ordered

    def common_least(n_a, n_b):
        return F.ceil((n_a + n_b) * part / (part + whole))

    needed = common_least(F.col("n_a"), F.col("n_b")) - F.least("common_a", "common_b")
    one, two = sides(family.where(F.col("common") * whole >= F.col("n") * part), ["b"], "common", "stray")
    inside = one.where("stray_a").join(two.hint(SORTED), "b").where(apart & stray & (needed <= 0))
    own_needed = F.greatest(F.lit(1), common_least(F.col("n"), F.greatest(
        F.ceil(F.col("n") * part / whole), F.col("least_n"))) - F.col("common"))
    member = ["b", "cls", "n", "root", "common", "stray", "needed"]
    own = family.withColumn("needed", own_needed).select(*member, F.explode("own").alias("value"))
    often = own.groupBy("b", "value").agg(F.count("*").alias("k")).where("k > 1")
    ranked = (own.join(often.hint(SORTED), ["b", "value"]).groupBy(*member)
              .agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("some"))
              .select(*member, F.size("some").alias("shared"), F.posexplode("some").alias("place", "entry"))
              # the entries from this one to the end; those before it, and those nobody shares, are rarer
              .select(*member, F.col("entry.value").alias("value"), (F.col("shared") - F.col("place")).alias("left"))
              .where(F.col("left") >= F.col("needed")))
    ranked = stash(ranked, "mixed-shingles")
    one, two = sides(ranked, ["b", "value"], "common", "stray", "left")
    outside = one.where("stray_a").join(two.hint(SORTED), ["b", "value"]).where(
        apart & stray & (F.least("left_a", "left_b") >= needed))

    cross = None
    for some in (loose, inside, outside):
        some = some.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()
        cross = some if cross is None else cross.union(some)
    pairs = _agreeing(cross, classes, matches)
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), classes, docs, shingle)
    more = _compared(pairs, sets, similarity)
    release(pairs, sets)
    all_roots = stash(components(links.union(more.where("linked").select("a", "b"))), "near-roots")

    # components are named by the smallest id of their classes
    owned = classes.select("key", "cls", "least").join(
        all_roots.withColumnRenamed("node", "cls").hint(SORTED), "cls", "left").select("key", "least", F.coalesce("root", "cls").alias("root"))
    least = stash(owned.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    named = stash(owned.join(least.hint(SORTED), "root").select("key", "component_id"), "class-components")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    release(classes, posts, hubs, near, *moves, roots, lists, family, ranked, more, all_roots, least)
    carried = [F.col(f"carry_{c}").alias(c) for c in carry]
    return (rows.select("doc_id", "n_shingles", "key", *carried).join(named.hint(SORTED), "key", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.col("doc_id").eqNullSafe(component).alias("kept"), *carry))
