"""MinHash near-duplicate classes with tensored banding.

Table keys are pairs of half-keys: one from collection A, one from collection B. m half-keys on either side give m * m
tables, so that 2 * m * rows minhashes do the work of m * m * 2 * rows: about a square root. Every candidate link is
confirmed on full shingle sets.

How links are found without all pairs of a bucket:

1. Texts with the same shingle set are one class from the start: a grouping by a 128-bit hash of the set, whose classes
   get numbers of their own.
2. In every bucket each class is compared with the bucket's smallest and largest class (its hubs): rows in proportion to
   the bucket.
3. Confirmed links give components. Buckets whose classes are in one component are settled, as more links between them
   change nothing.
4. The classes of the other buckets go through an exact prefix filter: two sets with a Jaccard similarity of t or more
   share one of the |s| - ceil(t |s|) + 1 shingles that are rarest among these classes, at places early enough to leave
   room for the overlap. There each class outside a key's largest component is compared with the classes of other
   components, until no key holds an untested pair; the rarest shingles of both sets turn most pairs away at once. So no bucket is capped, and no pair that shares a bucket is lost.
   Only classes of about the same size meet, and a key that many classes share is dealt to many tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.common import cut, map_texts, quoted, release, whole_row
from duoscope.llm.components import components

_PRIME_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEPARATE = np.uint64(0xD6E8FEB86659FD93)
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _SEPARATE
    x = (x ^ (x >> np.uint64(32))) * _SEPARATE
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, k: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; one for the whole sequence of fewer words; none without."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            if len(memo) < 200_000:
                memo[w] = h
        ids.append(h)
    w = np.array(ids, np.uint64)
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        h = _mix(h * _PRIME_MIX + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    draw = lambda: r.randint(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, n, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def half_keys(s: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for every `rows` minhashes of the set."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        v = s[None, at : at + 4096] * a[:, None] + b[:, None]
        v ^= v >> np.uint64(29)
        np.minimum(least, v.min(axis=1), out=least)
    key = np.zeros(len(a) // rows, np.uint64)
    for j in range(rows):
        key = _mix(key * _PRIME_MIX + least[j::rows])
    return key


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, halves: int = 9, rows: int = 2, seed: int = 7) -> DataFrame:
    """A row per input row: id, n_shingles, s1 and s2 (128-bit set hash), half (2 * halves longs; null without shingles)."""
    def make() -> Callable[[str | None], tuple]:
        memo: dict[bytes, int] = {}
        a, b = _coefficients(2 * halves * rows, seed)

        def sign(text: str | None) -> tuple:
            s = shingle_hashes(text, k, memo)
            if not len(s):
                return 0, 0, 0, None
            return len(s), *_set_hash(s.tobytes()), half_keys(s, a, b, rows).view(np.int64)

        return sign

    return map_texts(docs, [F.col(id_col).cast("long").alias("id")], text_col, "n_shingles long, s1 long, s2 long, half array<long>", make)


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, s binary): the sorted 64-bit shingle hashes of each wanted class (node, s1, s2, rep), once."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for pdf in batches:
            every = [shingle_hashes(t, k, memo).tobytes() for t in pdf["text"]]
            yield pd.DataFrame([(*_set_hash(s), s) for s in every], columns=["s1", "s2", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(wanted.select("rep"), "rep", "left_semi")
    sets_of = texts.select("text").mapInPandas(sets, "s1 long, s2 long, s binary").dropDuplicates(["s1", "s2"])
    return sets_of.join(wanted.select("node", "s1", "s2"), ["s1", "s2"]).select("node", "s")


def _set_hash(s: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(s, digest_size=16).digest(), np.int64).tolist())


def _confirm(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b; and hub, one of them) whose full sets have per_cent or more of their union in common."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                keep.append(100 * both >= per_cent * (len(u) + len(v) - both))
            yield pdf.loc[keep, ["a", "b"]]

    # a hub of very many pairs meets its set while rows are small; the pairs then spread by their other ends
    left = sets.select(F.col("node").alias("hub"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("other"), F.col("s").alias("sb"))
    ends = pairs.select("a", "b", "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    return ends.join(left, "hub").join(right, "other").select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


#: So many of a set's rarest shingles are looked at before a pair of sets is.
_HEAD = 128


def _prefixes(sets: DataFrame, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, n, pos) for the rarest |s| - ceil(t |s|) + 1 shingles of each set; rare as counted over these sets.

    And (node, head): those of the set's _HEAD rarest shingles that another set has, in order of rarity.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = np.array([len(s) // 8 for s in pdf["s"]], np.int64)
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), n), "n": np.repeat(n, n), "key": np.frombuffer(b"".join(pdf["s"]), np.int64)})

    each = sets.mapInPandas(explode, "node long, n long, key long")
    df = each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # keys of one set only join nothing; they still fill the prefix, so their number is counted
    shared = each.join(df, "key")
    w = Window.partitionBy("node").orderBy("df", "key")
    ranked = shared.withColumn("r", F.row_number().over(w)).withColumn("shared", F.count("*").over(Window.partitionBy("node"))).withColumn("pos", F.expr("r + n - shared"))
    first = ranked.where(f"pos <= greatest({_HEAD}, n - ceil(n * {per_cent} / 100) + 1)").select("key", "node", "n", "pos")
    first = cut(first, "prefixes")
    head = first.where(f"pos <= {_HEAD}").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("head"))
    keys = cut(first.where(f"pos <= n - ceil(n * {per_cent} / 100) + 1"), "keys")
    heads = cut(head, "heads")
    release(first)
    return keys, heads


def _candidates(here: DataFrame, heads: DataFrame, per_cent: int, task_pairs: int = 1 << 20) -> DataFrame:
    """(a, b, hub): the classes outside the largest component of a key (hubs) with those of its other components.

    here: key, node, n, pos, comp; heads: node, head. Only pairs that can be similar enough come out, each at its rarest common shingle:
    - two such sets differ in size by a factor of 100 / per_cent at most, so bands of that width meet their own kind and
      their neighbours;
    - what follows the places of the shared key must leave room for the overlap;
    - so must the two heads: a common shingle is in both, or behind the end of one of them.
    The last one turns away the many pairs of a group of copies that lie just beyond the bound, before anything of them is
    written or shuffled. Where a key's meetings are more than task_pairs, the one side is dealt over as many salts as that
    takes, and the other side, which is the smaller one, goes to each.
    """
    by_comp = here.groupBy("key", "comp").agg(F.count("*").alias("c"))
    most = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("c").alias("all")).where("comps > 1")
    meetings = F.col("all") * (F.col("all") - F.col("top.c"))
    most = most.select("key", F.col("top.comp").alias("most"), F.ceil(meetings / task_pairs).cast("int").alias("salts"))
    width = 1.001 * math.log(100 / per_cent) if per_cent < 100 else 1.0
    here = here.join(most, "key").withColumn("band", F.floor(F.ln("n") / width).cast("int"))
    here = here.join(heads, "node", "left").withColumn("head", F.coalesce("head", F.array().cast("array<long>")))
    few = here.where("comp <> most").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    few = few.select("key", "band", "salt", F.col("node").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in ("n", "pos", "comp", "head")))
    many = here.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    many = many.select("key", "node", "n", "pos", "comp", "head", "salt", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"))
    enough = lambda overlap: F.expr(f"{100 + per_cent} * ({overlap}) >= {per_cent} * (n + hub_n)")
    fits = F.expr(f"100 * least(n, hub_n) >= {per_cent} * greatest(n, hub_n)")
    near = fits & enough("1 + least(n - pos, hub_n - hub_pos)") & enough(f"size(array_intersect(head, hub_head)) + greatest(n - {_HEAD}, hub_n - {_HEAD}, 0)")
    rarest = F.expr("coalesce(get(array_intersect(head, hub_head), 0), key) = key")
    pairs = many.join(few, ["key", "band", "salt"]).where((F.col("comp") != F.col("hub_comp")) & near & rarest)
    return _unordered(pairs)


def _unordered(pairs: DataFrame) -> DataFrame:
    """(a, b, hub) with a < b, once for every pair of (hub, node); hub is the one of them that was met as a hub."""
    return pairs.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.min("hub").alias("hub"))


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, per_cent: int = 80, halves: int = 9, rows: int = 2, seed: int = 7
) -> DataFrame:
    """Near-duplicate classes of texts: (id, n_shingles, component_id, kept), a row per input row.

    Two rows are linked if 100 * |intersection| >= per_cent * |union| of their sets of k-word shingles over lower-cased
    (A-Z) words. component_id is the smallest id that a row reaches over links, kept is id = component_id. A text
    without words (null, empty, white space) links with nothing and is kept. Rows of one id belong together if either
    links; a null id has n_shingles and a null component_id and is kept, as nothing names it. Order, ties and repeated
    rows change nothing. Other columns of the input are not read. A pair at exactly 0.8 shares a table with
    probability 1 - 2 * 0.36 ** halves; pairs above it more often.
    """
    sig = cut(signatures(docs, id_col, text_col, k, halves, rows, seed))
    named = sig.where("n_shingles > 0 and id is not null")
    # a number names a class in what follows; it is written once, and its smallest id comes back at the end
    classes = named.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("half").alias("half"), F.max("n_shingles").alias("n"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    keys_of = F.transform(
        F.sequence(F.lit(0), F.lit(halves * halves - 1)),
        lambda t: F.xxhash64(F.element_at("half", (t / halves).cast("int") + 1), F.element_at("half", t % halves + halves + 1), t),
    )
    keyed = classes.select("node", "n", F.explode(keys_of).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    members = cut(keyed.join(buckets, "key"))
    sizes = classes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    fits = F.expr(f"100 * least(n, hub_n) >= {per_cent} * greatest(n, hub_n)")
    stars = members.select(F.explode(F.array("hub", "last")).alias("hub"), "node", "n").where("hub <> node").join(sizes, "hub").where(fits)
    tested = cut(_unordered(stars), "pairs")
    wanted = members.select("node").distinct().join(classes.select("node", "s1", "s2", "rep"), "node")
    sets = cut(shingle_sets(docs, wanted, id_col, text_col, k))
    links = cut(_confirm(tested, sets, per_cent), "links")
    comp = cut(components(links), small=True)

    def placed(d: DataFrame) -> DataFrame:
        return d.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    here = placed(members.select("key", "node"))
    unsettled = here.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rest = cut(here.join(unsettled, "key", "left_semi").select("node").distinct(), small=True)
    keys, heads = (None, None) if rest.isEmpty() else _prefixes(sets.join(rest, "node", "left_semi"), per_cent)
    release(members)
    while keys is not None:
        pairs = cut(_candidates(placed(keys), heads, per_cent).join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        more = cut(_confirm(pairs, sets, per_cent), "links")
        if more.isEmpty():
            break
        links, tested = links.union(more), tested.union(pairs)
        last, comp = comp, cut(components(links), small=True)
        release(last)
    release(keys, heads, sets, rest)

    out = in_classes(sig, classes, comp)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def in_classes(sig: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id): the rows of sig with the smallest id of the component that their class is in.

    sig: id, n_shingles, s1, s2; classes: node, s1, s2, rep (the smallest id); comp: node, comp (others are alone). Both are
    cut() tables, and go. Rows of one id with different texts tie their components.
    """
    named = sig.where("n_shingles > 0 and id is not null")
    least = classes.select("node", "s1", "s2", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = least.join(least.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("s1", "s2", "component_id")
    least = cut(least, "least")
    release(classes, comp)
    ids = named.select("id", "s1", "s2").join(least, ["s1", "s2"])
    twice = cut(ids.groupBy("id").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y"), small=True)
    if not twice.isEmpty():
        tie = components(ids.join(twice, "id", "left_semi").select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        tie = cut(tie.select(F.col("node").alias("component_id"), F.col("comp").alias("tied")))
        least = least.join(tie, "component_id", "left").select("s1", "s2", F.coalesce("tied", "component_id").alias("component_id"))
    in_class = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    found = sig.select("id", "n_shingles", F.when(in_class, F.col("s1")).alias("s1"), "s2").join(least, ["s1", "s2"], "left")
    return found.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that near_classes() keeps, with all their columns: one row of each class.

    Of the rows of a class the one with the smallest id stays; of rows that share that id, one. Texts without words and
    null ids are in no class: all such rows stay.
    """
    kept = near_classes(docs, id_col, text_col, **how)
    kept = cut(kept.where("kept and id is not null").groupBy("id").agg(F.max("n_shingles").alias("n")), "kept")
    row = docs.select(whole_row(docs).alias("__row"), F.col(id_col).cast("long").alias("__id"))
    nameless = row.where("__id is null").select("__row")
    row = row.join(kept.select(F.col("id").alias("__id"), "n"), "__id")
    twice = cut(row.groupBy("__id").agg(F.count("*").alias("c")).where("c > 1").select("__id"), "twice")
    once = row.join(twice, "__id", "left_anti").select("__row")
    pick = row.join(twice, "__id", "left_semi").where("n > 0").groupBy("__id").agg(F.min(F.struct(F.col(f"__row.{quoted(text_col)}").alias("t"), "__row")).alias("p"))
    blank = row.join(twice, "__id", "left_semi").where("n = 0").select("__row")
    return once.union(pick.select("p.__row")).union(blank).union(nameless).select("__row.*")


#: All links of small tables: sets of texts that share a shingle are compared, and components found by rounds.
NEAR_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from d),
classes as (select min(doc_id) as rep, list_sort(s) as s, any_value(len(s)) as n from s where len(s) > 0 group by list_sort(s)),
x as (select rep, n, unnest(s) as g from classes),
links as (select a.rep as a, b.rep as b from x a join x b on a.g = b.g and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ as (select a, b from links union all select b, a from links),
reach as (select rep as a, rep as b from classes union select r.a, e.b from reach r join both_ e on r.b = e.a),
comp as (select a as rep, min(b) as component_id from reach group by a),
found as (select s.doc_id, len(s.s) as n_shingles, coalesce(component_id, s.doc_id) as component_id from s left join classes c on list_sort(s.s) = c.s left join comp on comp.rep = c.rep)
select doc_id, cast(n_shingles as bigint) as n_shingles, component_id, doc_id = component_id as kept from found
"""
