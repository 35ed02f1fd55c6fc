"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Texts with the same shingle set are one class; links are looked for between classes.

1. Bands of size: two sets with a Jaccard similarity of t or more differ in size by a factor of 1 / t at most, so with bands
   of that width a set meets sets of its own band and of the two beside it. The tiles of a band hold its own sets and those
   of the next one: a set is in the tiles of its band and of the band below.
2. Tiles of a band: linked sets of it differ in at most h shingles, which the band's greatest size fixes. So every set is cut
   into h + 1 pieces by the hash of its shingles, and linked sets have one piece, the whole of it, in common. A tile holds
   the sets of a band with the same piece; texts that share a passage but little else meet in none.
3. Bitmaps: a bit for each of 64 to 8192 hash values, set where an odd number of the shingles has it. Bits in which two
   bitmaps differ are shingles that are in one set only, so their count bounds the overlap from above. Wider bitmaps are
   folded to the width of narrower ones.
4. Pairs that the bound lets through are settled by intersecting the sorted sets.

A tile isn't multiplied out: each of its classes meets the smallest and the largest one first, confirmed links give
components, and only tiles with classes of several components go on. There the classes outside the largest component meet
all others by their bitmaps, in blocks of bounded size; a pair comes out at the first tile that both its sets are in. One
such pass leaves no pair of a tile that isn't in one component, turned away by its bound, or confirmed or refuted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import cut, map_texts, release
from duoscope.llm.components import components
from duoscope.llm.minhash import NEAR_SQL, _confirm, _mix, _set_hash, _unordered, in_classes, shingle_hashes, shingle_sets

#: Classes of a tile that one task compares with as many: some 2 MB of bitmaps.
BLOCK_ROWS = 1 << 11
#: So many of a set's tiles are looked at to find the first one that two sets share.
_FIRST = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_edges(per_cent: int, up_to: int) -> list[int]:
    """The smallest size of each band, until one lies beyond up_to."""
    edges = [1]
    while edges[-1] <= up_to:
        edges.append(edges[-1] * 100 // per_cent + 1)
    return edges


def piece_keys(s: np.ndarray, band: int, end: int, per_cent: int) -> np.ndarray:
    """A key for each piece of the set in the tiles of a band, whose sizes are below `end`.

    A set of n <= end - 1 shingles and a linked one, at most n / t large, have up to n * (1 - t) / t shingles that aren't in both.
    """
    pieces = (end - 1) * (100 - per_cent) // per_cent + 1
    at = (_mix(s) % np.uint64(pieces)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s[order] * _ODD))])  # modulo 2 ** 64
    ends = np.searchsorted(at[order], np.arange(pieces + 1))
    piece = sums[ends[1:]] - sums[ends[:-1]]
    return _mix(_mix(piece + np.arange(pieces, dtype=np.uint64) * _ODD) + np.uint64(band)).view(np.int64)


def _tiles(docs: DataFrame, id_col: str, text_col: str, k: int, per_cent: int) -> DataFrame:
    """A row per input row: id, n_shingles, s1 and s2 (128-bit set hash), own and below (keys in the band's tiles and the lower band's)."""

    def make() -> Callable[[str | None], tuple]:
        memo: dict[bytes, int] = {}
        edges = band_edges(per_cent, 1)

        def of(text: str | None) -> tuple:
            s = shingle_hashes(text, k, memo)
            if not len(s):
                return 0, 0, 0, None, None
            while edges[-1] <= len(s):
                edges.append(edges[-1] * 100 // per_cent + 1)
            band = int(np.searchsorted(edges, len(s), "right")) - 1
            own = piece_keys(s, band, edges[band + 1], per_cent)
            below = piece_keys(s, band - 1, edges[band], per_cent) if band else own[:0]
            return len(s), *_set_hash(s.tobytes()), own, below

        return of

    schema = "n_shingles long, s1 long, s2 long, own array<long>, below array<long>"
    return map_texts(docs, [F.col(id_col).cast("long").alias("id")], text_col, schema, make)


def bitmap(s: np.ndarray, most: int = 8192) -> bytes:
    """A bit per hash value, about eight for each shingle: on where an odd number of shingles has the value."""
    width = 64
    while width < min(most, 8 * len(s)):
        width *= 2
    bits = np.bincount((_mix(s ^ _ODD) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: Sequence[bytes]) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, all folded to the narrowest: bits of one place modulo its width are added up."""
    narrow = min(map(len, bits)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, narrow), axis=0) for b in bits])


def can_link(x: np.ndarray, n: int, y: np.ndarray, m: np.ndarray, per_cent: int) -> np.ndarray:
    """Which sets (sizes m, bitmaps y) may have per_cent of their union in common with the set (n, x)."""
    differ = np.bitwise_count(y ^ x).sum(axis=1, dtype=np.int64)
    overlap = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return (100 + per_cent) * overlap >= per_cent * (n + m)


def _bitmaps(sets: DataFrame) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [np.frombuffer(x, np.uint64) for x in pdf["s"]]
            yield pd.DataFrame({"node": pdf["node"], "n": [len(x) for x in s], "bits": [bitmap(x) for x in s]})

    return sets.mapInPandas(of, "node long, n long, bits binary")


def _bounded(pairs: DataFrame, bits: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b, hub) that their bitmaps let through."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [bool(can_link(w[0], n, w[1:], np.array([m]), per_cent)[0]) for w, n, m in zip(map(folded, zip(pdf["x"], pdf["y"], strict=True)), pdf["n"], pdf["m"], strict=True)]
            yield pdf.loc[keep, ["a", "b", "hub"]]

    x = bits.select(F.col("node").alias("hub"), "n", F.col("bits").alias("x"))
    y = bits.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("bits").alias("y"))
    ends = pairs.withColumn("other", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    sized = f"100 * least(n, m) >= {per_cent} * greatest(n, m)"
    return ends.join(x, "hub").join(y, "other").where(sized).mapInPandas(check, "a long, b long, hub long")


def _meet(block: dict[str, np.ndarray], per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hub, node): pairs of the rows of one block of a tile that may link, at the first tile that both are in."""
    n, comp, node, few, pos, most = (block[c] for c in ("n", "comp", "node", "few", "pos", "most"))
    hub, many = np.flatnonzero(few), np.flatnonzero(~few)
    # a class outside the largest component is on both sides; two of them meet once
    meet = (comp[many] != comp[hub][:, None]) & ((most[many] == comp[many]) | (node[many] > node[hub][:, None]))
    meet &= 100 * np.minimum(n[many], n[hub][:, None]) >= per_cent * np.maximum(n[many], n[hub][:, None])
    if not meet.any():
        return node[:0], node[:0]
    words, first = folded(block["bits"]), np.stack(block["first"])
    hubs, nodes = [], []
    for at in np.flatnonzero(meet.any(axis=1)):
        i, j = hub[at], many[meet[at]]
        j = j[can_link(words[i], int(n[i]), words[j], n[j], per_cent)]
        j = j[~(first[j, : pos[i]] == first[i, : pos[i]]).any(axis=1)]
        hubs.append(np.full(len(j), node[i]))
        nodes.append(node[j])
    return np.concatenate(hubs), np.concatenate(nodes)


def _candidates(here: DataFrame, bits: DataFrame, firsts: DataFrame, per_cent: int) -> DataFrame:
    """(a, b, hub): the pairs of classes of a tile and of different components that their bitmaps let through.

    here: key, node, low (the tile is of the band below), pos, comp. A tile's classes outside its largest component (few)
    are dealt into blocks, all its classes likewise, and every block of the first kind meets every one of the second.
    """
    by_comp = here.groupBy("key", "comp").agg(F.count("*").alias("c"))
    tiles = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("c").alias("every")).where("comps > 1")
    blocks = lambda c: F.ceil(c / F.lit(float(BLOCK_ROWS))).cast("int")
    tiles = tiles.select("key", F.col("top.comp").alias("most"), blocks(F.col("every") - F.col("top.c")).alias("bf"), blocks(F.col("every")).alias("bm"))
    rows = here.join(tiles, "key").join(bits, "node").join(firsts, ["node", "low"])
    part = lambda b: F.pmod(F.xxhash64("node"), F.col(b)).cast("int")
    all_of = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    cols = ["key", "node", "n", "pos", "comp", "most", "bits", "first"]
    few = rows.where("comp <> most").select(*cols, F.lit(True).alias("few"), part("bf").alias("x"), all_of("bm").alias("y"))
    many = rows.select(*cols, F.lit(False).alias("few"), all_of("bf").alias("x"), part("bm").alias("y"))
    met = few.union(many).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    names = ["n", "comp", "node", "few", "pos", "most", "bits", "first"]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []  # the rows of the last block so far
        last = None
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def end() -> None:
            if held:
                found.append(_meet({c: np.concatenate([part[c] for part in held]) for c in names} if len(held) > 1 else held[0], per_cent))
                held.clear()

        for pdf in batches:
            at = pdf[["key", "x", "y"]].to_numpy()
            rows = {c: pdf[c].to_numpy() for c in names}
            starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a or last is None or (last != at[0]).any():
                    end()
                held.append({c: v[a:b] for c, v in rows.items()})
            last = at[-1]
            yield pd.DataFrame({"hub": np.concatenate([x[0] for x in found] or [at[:0, 0]]), "node": np.concatenate([x[1] for x in found] or [at[:0, 0]])})
            found.clear()
        end()
        if found:
            yield pd.DataFrame({"hub": found[0][0], "node": found[0][1]})

    return _unordered(met.mapInPandas(pairs, "hub long, node long"))


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, per_cent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id): a row per input row, component_id the smallest id that the row reaches over links.

    Two rows are linked if 100 * |intersection| >= per_cent * |union| of their sets of k-word shingles over lower-cased
    (A-Z) words; per_cent is 1 to 100. No link is missed. A text without words (null, empty, white space) links with nothing.
    Rows of one id belong together if either links; a null id has n_shingles and a null component_id. Ties, order and
    repeated rows change nothing; an empty table gives an empty one. Other columns of the input are not read. A text is held
    whole with its words and shingles, some 25 times its bytes.
    """
    if not 1 <= per_cent <= 100:
        raise ValueError("per_cent must be from 1 to 100")
    sig = cut(_tiles(docs, id_col, text_col, k, per_cent), "tiles")
    named = sig.where("n_shingles > 0 and id is not null")
    classes = named.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("own").alias("own"), F.first("below").alias("below"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    each = lambda c, low: classes.select("node", F.lit(low).alias("low"), F.posexplode(c).alias("pos", "key"))
    keyed = each("own", False).union(each("below", True))
    ends = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    members = cut(keyed.join(ends, "key"), "members")
    stars = members.select(F.explode(F.array("hub", "last")).alias("hub"), "node").where("hub <> node")
    wanted = members.select("node").distinct().join(classes.select("node", "s1", "s2", "rep"), "node")
    sets = cut(shingle_sets(docs, wanted, id_col, text_col, k), "sets")
    bits = cut(_bitmaps(sets), "bitmaps")
    tested = cut(_bounded(_unordered(stars), bits, per_cent), "pairs")
    links = cut(_confirm(tested, sets, per_cent), "links")
    comp = cut(components(links), "components", small=True)

    here = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    unsettled = here.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("key")
    here = cut(here.join(unsettled, "key", "left_semi").select("key", "node", "low", "pos", "comp"), "unsettled")
    if not here.isEmpty():
        of = lambda c, low: classes.select("node", F.lit(low).alias("low"), F.slice(c, 1, _FIRST).alias("first"))
        rest = here.select("node").distinct()
        firsts = of("own", False).union(of("below", True)).join(rest, "node", "left_semi")
        pairs = cut(_candidates(here, bits, firsts, per_cent).join(tested, ["a", "b"], "left_anti"), "pairs")
        more = cut(_confirm(pairs, sets, per_cent), "links")
        release(pairs)
        if not more.isEmpty():
            last, comp = comp, cut(components(links.union(more)), "components", small=True)
            release(last)
        release(more)
    release(here, members, sets, bits, tested, links)
    return in_classes(sig, classes, comp).select("id", "n_shingles", "component_id")


#: All links of small tables, as beside the near-duplicates: three-word shingles, nine tenths.
NGRAM_SQL = (
    NEAR_SQL.replace("len(w) < 4", "len(w) < 3").replace("range(1, len(w) - 2)", "range(1, len(w) - 1)").replace("w[i:i + 3]", "w[i:i + 2]")
    .replace(">= 80 *", ">= 90 *").replace(", doc_id = component_id as kept", "")
)
