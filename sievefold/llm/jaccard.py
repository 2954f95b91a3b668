"""N-gram Jaccard join with multiple-global-order filtering.

Two texts link when the Jaccard similarity of their shingle sets is at least
``percent`` / 100.  If so, under *any* global order of the tokens their prefixes share
a token; the prefix of a set of n tokens is its first ``n - ceil(percent * n / 100) + 1``.
The smaller set has the first shared token even in its *core*, the first
``n - ceil(2 * percent * n / (100 + percent)) + 1``, so two sets that share tokens only
outside both cores needn't be compared.

1. One pass over the texts hashes the shingle sets.  Texts with equal sets are one
   class from here on.
2. First order: a pseudo-random ``band`` of the tokens first, in it rare before frequent,
   then the other tokens by hash.  Only the band's tokens, and of a set whose band is
   shorter than its prefix the next ones, are counted and joined; a band token of one
   class only is dropped at once.  The classes that share a prefix token are its *list*, if it is in the
   core of one of them (of lists of the same classes one is kept); classes that
   are joined over lists form a *cell*: linked classes are always in one cell.
3. A second pass hashes again the classes that share a cell with another, and the same
   filter under an independent order splits the cells further.  A third pass makes the
   whole sets of those still in a cell with another.
4. A cell of at most ``2 * BLOCK`` sets is verified as one block.  In a larger one every
   class of a list is first held against one hub of the list, which is linear and joins
   most of a group of near copies.  Then only pairs of different components are open:
   classes outside the largest component of their list (or cell, if that is less work)
   meet the rest of it in blocks of bounded size (or classes of the core, if they are fewer).
5. In a block a pair is verified only if its sizes are near enough, it shares a prefix
   token under two further orders too, and it isn't in one component already.  Blocks
   give a spanning forest, never all pairs of a group.
6. The forests' components, over all blocks, are the answer.

Many texts of one list that are alike but not linked, say 0.7 alike, remain one by one
to be verified: no filter on prefixes can tell them from linked ones, and none is dropped.

Sets are identified by two 64-bit hashes, tokens by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches, checked_broadcast, discard_since, key_filter, made, materialize
from ._text import chunks, mix64, shingle_sets
from .components import components

#: Sets of a part of a block, and the tokens that they hold.
BLOCK, BLOCK_TOKENS = 512, 1 << 19
_ORDERS = (np.uint64(0), np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B))
_SALTS = (np.uint64(0x9E37), np.uint64(0x3C6EF372FE94F82B))


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n * (100 - percent) // 100 + 1


def _core_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n * (100 - percent) // (100 + percent) + 1


def _ordered(tokens: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """Tokens under the given order: mapped by a bijection and sorted within each set."""
    if order == 0:
        return tokens
    out = mix64(tokens ^ _ORDERS[order])
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        out[a:b].sort()
    return out


def _share_end(share: float) -> int:
    return int(share * 2**64) if share < 1 else 2**64 - 1


def _band(tokens: np.ndarray, offs: np.ndarray, percent: int, share: float) -> list[pa.Array]:
    """Of ordered tokens, the leading ``share`` of the hash range and at least the prefix,
    as lists; by how much the band exceeds the prefix, and this the core."""
    n = np.diff(offs)
    low = tokens < np.uint64(_share_end(share))
    cum = np.concatenate([[0], np.cumsum(low, dtype=np.int64)])
    need = np.minimum(_prefix_length(n, percent), n)
    size = np.maximum(cum[offs[1:]] - cum[offs[:-1]], need)
    at = np.concatenate([[0], np.cumsum(size)])
    pick = np.arange(at[-1]) + np.repeat(offs[:-1] - at[:-1], size)
    core = np.minimum(_core_length(n, percent), need)
    return [_lists(tokens[pick], at), *(pa.array(x.astype(np.int32)) for x in (size - need, need - core))]


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values.view(np.int64)))


def _signatures(tokens: np.ndarray, offs: np.ndarray, which: int) -> np.ndarray:
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(tokens + _SALTS[which]), dtype=np.uint64)])
    return mix64(cum[offs[1:]] - cum[offs[:-1]] + np.diff(offs).astype(np.uint64))


#: What ``_band`` gives.
_BAND = "band array<long>, room int, rim int"


def shingle_table(docs: DataFrame, width: int, percent: int, share: float, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, sig, sig2, band, room, rim) for every row."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            tokens, offs = shingle_sets(part.column(1), width)
            n = np.diff(offs)
            sigs = [pa.array(_signatures(tokens, offs, k).view(np.int64), mask=n == 0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *sigs, *_band(tokens, offs, percent, share)], ["doc_id", "n", "sig", "sig2", "band", "room", "rim"])

    given = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, n long, sig long, sig2 long, {_BAND}")


def classes_of(sets: DataFrame) -> DataFrame:
    """One row per set of shingles that occurs: (sig, sig2, node, h, n, k, first_id, band,
    room, rim).  ``k`` rows have it; the row of the smallest id hash ``h`` stands for it, and
    ``node`` names it: that hash, which is one-to-one for whole numbers, or for rows
    without id one of the set."""
    h = F.xxhash64("doc_id")
    node = F.when(F.col("doc_id").isNotNull(), h).otherwise(F.xxhash64("sig", "sig2"))
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), node.alias("node"), h.alias("h"), "n")
    few = sets.where("n > 0").groupBy("sig", "sig2").agg(F.min(rep).alias("r"), F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("band", "room", "rim")))
    return few.select("sig", "sig2", "r.node", "r.h", "r.n", "k", "first_id", "band", "room", "rim")


def shared_prefixes(rows: DataFrame, within: list[str], share: float) -> DataFrame:
    """(node, *within, token, core): the prefix tokens that a class shares with another of
    its ``within`` columns, and whether they are in its core.  ``rows``: node, band, room,
    rim, *within, of bands of this ``share``.

    One order holds for all sets: tokens below the share come first, rare before frequent,
    then the others by their hash.  Only the first kind is counted over all sets that have
    it: a short set's band goes on beyond the share, where other sets' bands may end."""
    hashed = F.col("token").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order on signed numbers
    high = hashed >= F.lit(_share_end(share) - (1 << 63))
    posts = rows.select("node", *within, F.explode("band").alias("token"))
    counts = posts.groupBy(*within, "token").agg(F.count(F.lit(1)).alias("df")).withColumn("high", high).where("df > 1 OR high")
    shared = posts.join(counts, [*within, "token"]).select("node", *within, "token", "df", "high")
    own = Window.partitionBy("node")
    order = own.orderBy("high", F.when(F.col("high"), F.lit(0)).otherwise(F.col("df")), hashed)
    ranked = shared.withColumn("at", F.row_number().over(order)).withColumn("k", F.count(F.lit(1)).over(own))
    # a token of one class is left out only where such come first, so ``room`` and ``rim`` count off the other end
    last = F.col("k") - F.col("room")
    kept = ranked.where("df > 1").join(rows.select("node", "room", "rim"), "node").where(F.col("at") <= last)
    return kept.select("node", *within, "token", (F.col("at") <= last - F.col("rim")).alias("core"))


def cells(prefix: DataFrame, within: list[str]) -> DataFrame:
    """(node, component) of classes that share a prefix token with another one that has it
    in its core, directly or over others."""
    hubs = prefix.groupBy(*within, "token").agg(F.min(F.when(F.col("core"), F.col("node"))).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1 AND hub IS NOT NULL").drop("k")
    return components(prefix.join(hubs, [*within, "token"]).select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _again(docs: DataFrame, chosen: DataFrame, width: int, doc_id: str, text: str, schema: str, emit) -> DataFrame:
    """Hashes the texts of the classes in ``chosen`` (sig, sig2, h and others, stored) again, in
    the row that stands for each: the others and what ``emit`` makes of the tokens.

    A filter of bounded size picks the texts, and what was made of them is joined with the
    classes by a shuffle: texts aren't shuffled, and no table of classes is broadcast."""
    bits, may_be_chosen = key_filter(chosen, "h")
    keys = ["sig", "sig2", "h"]
    names = ["h", "sig", "sig2", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            tokens, offs = shingle_sets(part.column(1), width)
            sigs = [pa.array(_signatures(tokens, offs, k).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *sigs, *emit(tokens, offs)], names)

    given = docs.select(F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).cast("string").alias("text")).join(bits, may_be_chosen, "left_semi")
    found = bounded_batches(given).mapInArrow(run, f"h long, sig long, sig2 long, {schema}")
    return found.join(chosen, keys).dropDuplicates(keys).drop(*keys)  # rows of one id with one text


def _second_bands(docs: DataFrame, chosen: DataFrame, width: int, percent: int, share: float, doc_id: str, text: str) -> DataFrame:
    """(node, cell, band, room, rim) of the chosen classes under the second order."""

    def emit(tokens: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        return _band(_ordered(tokens, offs, 1), offs, percent, share)

    return _again(docs, chosen.drop("n"), width, doc_id, text, _BAND, emit)


def _member_tokens(docs: DataFrame, chosen: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(node, cell, is_small, tokens): whole sets, packed."""

    def emit(tokens: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        raw = tokens.tobytes()
        return [pa.array([raw[8 * a : 8 * b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())]

    return _again(docs, chosen.drop("n"), width, doc_id, text, "tokens binary", emit)


def _n_parts(rows: str, tokens: str) -> Column:
    """Into how many parts so many sets with so many tokens are cut."""
    return F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(tokens) / BLOCK_TOKENS)).cast("int")


def _part(p: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(p)).cast("int")


def _every(p: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(p) - 1))


def _lists_of(prefix: DataFrame, members: DataFrame) -> DataFrame:
    """(cell, token, node, n, core): the lists of the members' cells that hold a pair to be
    compared; of lists with the same classes, in core and rim, one."""
    rows = materialize(prefix.join(members, "node").select("cell", "token", "node", "n", "core"))
    same = [F.bit_xor(F.xxhash64("node", "core")).alias("x"), F.sum(F.hash("node", "core").cast("long")).alias("y")]
    found = rows.groupBy("cell", "token").agg(F.count(F.lit(1)).alias("k"), F.max("core").alias("any"), *same).where("k > 1 AND any")
    return rows.join(found.groupBy("cell", "k", "x", "y").agg(F.min("token").alias("token")).select("cell", "token"), ["cell", "token"])


def _hub_blocks(lists: DataFrame, percent: int) -> DataFrame:
    """Blocks that hold every class against one hub: of the hubs of its lists, each the
    class of the smallest hash in the list's core, the one of the smallest hash.  A hub's
    partners are dealt out over blocks, so every class is shipped once."""
    first = F.when(F.col("core"), F.struct(F.xxhash64("node").alias("o"), "node", "n"))
    hubs = lists.groupBy("cell", "token").agg(F.min(first).alias("hub"))
    met = lists.join(hubs, ["cell", "token"]).where((F.col("node") != F.col("hub.node")) & (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent))
    pairs = met.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct("hub.o", "hub.node")).alias("hub"))
    pairs = materialize(pairs.select("node", "n", F.col("hub.node").alias("hub")))
    cut = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w")).select("hub", _n_parts("k", "w").alias("p"))
    label = F.col("node").alias("label")
    others = pairs.join(cut, "hub").select("node", label, F.col("hub").alias("u"), _part("p").alias("i"), F.lit(1).alias("side"))
    own = cut.select(F.col("hub").alias("node"), F.col("hub").alias("label"), F.col("hub").alias("u"), _every("p").alias("i"), F.lit(0).alias("side"))
    none = F.lit(0)
    return others.union(own).select("node", "label", "side", "u", none.cast("long").alias("v"), none.alias("c"), "i", none.alias("j"))


def _other_blocks(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Blocks for the pairs that the hubs left open.

    A *unit* is a list or a whole cell, whichever ships fewer tokens for that cell.  In it
    only pairs of different labels (components so far) are open of which one is in the
    core.  So the classes outside its largest label, or those in its core, if these are
    fewer, meet all of the unit, in parts of bounded size, and only those of a like size.
    ``lists``: cell, token, node, core; ``members``: cell, node, n, label.
    """
    some = lists.join(members, ["cell", "node"]).select("cell", F.col("token").alias("u"), "node", "n", "label", "core")
    # u is null where the unit is the cell
    rows = materialize(some.unionByName(members.select("cell", F.lit(None).cast("long").alias("u"), "node", "n", "label", F.lit(True).alias("core"))))
    keys = ["cell", "u"]
    size = F.sum("n").alias("w")
    labels = rows.groupBy(*keys, "label").agg(size, F.sum(F.when(F.col("core"), F.col("n"))).alias("core_w"))
    units = labels.groupBy(*keys).agg(F.sum("w").alias("w"), F.coalesce(F.sum("core_w"), F.lit(0)).alias("core_w"), F.max(F.struct("w", "label")).alias("top"))
    minor_w = F.col("w") - F.col("top.w")
    by_core = F.col("core_w") < minor_w
    left_w = F.least(F.col("core_w"), minor_w)
    ships = F.when(minor_w > 0, left_w * F.ceil(F.col("w") / BLOCK_TOKENS) + F.col("w") * F.ceil(left_w / BLOCK_TOKENS)).otherwise(0)
    open_ = units.select(*keys, F.col("top.label").alias("top"), by_core.alias("by_core"), ships.alias("ships"))
    cost = open_.groupBy("cell").agg(*(F.coalesce(F.sum(F.when(c, F.col("ships"))), F.lit(0)).alias(x) for c, x in ((F.col("u").isNotNull(), "by_list"), (F.col("u").isNull(), "by_cell"))))
    chosen = open_.where("ships > 0").join(cost, "cell").where(F.col("u").isNotNull() == (F.col("by_list") < F.col("by_cell")))
    chosen = chosen.select(F.col("cell").alias("cell_"), F.col("u").alias("u_"), "top", "by_core")
    # sets that can link are at most 1 apart on this scale; four steps are a size class
    scale = F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / min(percent, 99))))
    class_ = lambda step: F.floor((F.col("s") + step) / 4).cast("int")
    left = F.when(F.col("by_core"), F.col("core")).otherwise(F.col("label") != F.col("top")).alias("left")
    picked = materialize(rows.join(chosen, (rows.cell == chosen["cell_"]) & rows.u.eqNullSafe(chosen["u_"])).select("cell", "u", "node", "n", "label", left, scale.alias("s")).withColumn("c", class_(0.0)))
    near = picked.where("left").withColumn("c", F.explode(F.array_distinct(F.array(class_(-1.001), class_(0.0), class_(1.001)))))
    unit = [*keys, "c"]
    parts = lambda x, p: x.groupBy(*unit).agg(F.count(F.lit(1)).alias("k"), size).select(*unit, _n_parts("k", "w").alias(p))
    a, b = parts(near, "p").alias("a"), parts(picked, "q").alias("b")
    cut = materialize(a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in unit]).select(*(F.col(f"a.{k}").alias(f"_{k}") for k in unit), "p", "q"))
    meet = lambda x: x.join(cut, [x[k].eqNullSafe(cut[f"_{k}"]) for k in unit])
    one = meet(near).select("node", "label", F.lit(0).alias("side"), *unit, _part("p").alias("i"), _every("q").alias("j"))
    all_ = meet(picked).select("node", "label", F.lit(1).alias("side"), *unit, _every("p").alias("i"), _part("q").alias("j"))
    return one.union(all_).select("node", "label", "side", F.col("cell").alias("u"), F.coalesce("u", F.lit(0)).alias("v"), "c", "i", "j")


def forest(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets of a block that are linked, directly or over others.

    ``side``: 0 or 1 where only pairs across are to be verified, else None.  Sets of equal
    ``labels`` are joined already."""
    k = len(sets)
    n = np.array([len(s) for s in sets])
    root = np.arange(k) if labels is None else np.unique(labels, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    prefix: list[tuple[np.ndarray, np.ndarray]] = []
    lengths = np.minimum(_prefix_length(n, percent), n)
    for order in (1, 2):
        heads = [np.sort(mix64(s ^ _ORDERS[order]))[:m] for s, m in zip(sets, lengths.tolist(), strict=True)]
        prefix.append((np.concatenate(heads), np.concatenate([[0], np.cumsum(lengths)])))
    flat, edge = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])

    def hits(values: np.ndarray, edges: np.ndarray, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many of the values of each of ``others`` are in ``own`` (sorted)."""
        size = edges[others + 1] - edges[others]
        to = np.cumsum(size)
        pick = values[np.arange(to[-1]) + np.repeat(edges[others] - (to - size), size)]
        found = own[np.minimum(np.searchsorted(own, pick), len(own) - 1)] == pick
        return np.add.reduceat(found, to - size, dtype=np.int64)

    for p in range(k):
        other = np.flatnonzero(root != root[p])
        other = other[other > p] if side is None else other[side[other] > side[p]]
        # sizes that can't reach the share
        other = other[np.minimum(n[other], n[p]) * 100 >= np.maximum(n[other], n[p]) * percent]
        for values, edges in prefix:
            if len(other):
                own = values[edges[p] : edges[p + 1]]
                other = other[hits(values, edges, own, other) > 0]
        if not len(other):
            continue
        common = hits(flat, edge, sets[p], other)
        linked = other[common * 100 >= (n[other] + n[p] - common) * percent]
        for q in linked.tolist():
            if root[q] != root[p]:
                out.append((int(nodes[p]), int(nodes[q])))
                root[root == root[q]] = root[p]
    return out


_KEYS = ["u", "v", "c", "i", "j"]


def _with_tokens(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    return tokens.join(checked_broadcast(materialize(blocks)), "node")


def _verify(blocks: DataFrame, percent: int, across: bool) -> DataFrame:
    """(a, b) links of a spanning forest of every block (node, label, side, tokens, *_KEYS)."""

    def flush(rows: list) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        node, label, side = (np.array([r[i] for r in rows]) for i in range(3))
        return forest(node, sets, side if across else None, percent, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        found: list[tuple[int, int]] = []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "label", "side", "tokens", *_KEYS)]
            for node, label, side, raw, *key in zip(*cols, strict=True):
                if held and held[0][4] != key:
                    found += flush(held)
                    held = []
                held.append((node, label, side, raw, key))
            if len(found) > 10_000:
                yield _links(found)
                found = []
        yield _links(found + flush(held))

    given = blocks.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return bounded_batches(given).select("node", "label", "side", "tokens", *_KEYS).mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def sized(members: DataFrame) -> DataFrame:
    """``members`` of cells of several classes, and whether the cell is one block (is_small)."""
    total = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).where("m > 1")
    is_small = (F.col("m") <= 2 * BLOCK) & (F.col("w") <= 2 * BLOCK_TOKENS)
    return members.join(total, "cell").withColumn("is_small", is_small).drop("m", "w")


def cell_links(members: DataFrame, prefix: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all linked classes.  ``members``: node, n, cell, is_small;
    ``prefix``: node, token under the first order; ``tokens``: node, cell, is_small, tokens."""
    none = F.lit(0)
    small = tokens.where("is_small").select("node", F.col("node").alias("label"), none.alias("side"), "tokens", F.col("cell").alias("u"), none.cast("long").alias("v"), *(none.alias(c) for c in "cij"))
    links = _verify(small, percent, across=False)
    large = materialize(members.where("NOT is_small").select("cell", "node", "n"))
    if large.isEmpty():
        return links
    lists = materialize(_lists_of(prefix, large))
    own = materialize(tokens.where("NOT is_small").select("node", "tokens"))
    by_hub = materialize(_verify(_with_tokens(_hub_blocks(lists, percent), own), percent, across=True))
    found = components(by_hub)
    labelled = materialize(large.join(found, "node", "left").select("cell", "node", "n", F.coalesce("component", "node").alias("label")))
    rest = _verify(_with_tokens(_other_blocks(lists.select("cell", "token", "node", "core"), labelled, percent), own), percent, across=True)
    return links.union(by_hub).union(rest)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", band: float | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Words are runs outside blank and \\x09-\\x0D, A-Z lower-cased.  A text of fewer than
    ``width`` words is one shingle; without words, or null, the set is empty, linked with
    nothing, and the component is the row's own id.  Rows with equal ids are one node.
    The component of rows with a null id is that of the texts they link with, null if
    there are none with an id.  An empty table gives an empty result; other columns are
    not read.  ``band`` is the share of the tokens that the first two orders count.
    """
    share = band or min(1.0, 2.0 * (100 - percent) / 100)
    before = made()
    sets = materialize(shingle_table(docs, width, percent, share, doc_id, text))
    classes = materialize(classes_of(sets))
    keys = classes.select("sig", "sig2", "node", "h", "n")
    prefix = materialize(shared_prefixes(classes.select("node", "band", "room", "rim"), [], share))
    first = cells(prefix, [])
    chosen = materialize(keys.join(first.withColumnRenamed("component", "cell"), "node"))
    bands = materialize(_second_bands(docs, chosen, width, percent, share, doc_id, text))
    second = materialize(shared_prefixes(bands, ["cell"], share))
    narrowed = materialize(chosen.drop("cell").join(cells(second, ["cell"]).withColumnRenamed("component", "cell"), "node"))
    narrowed = materialize(sized(narrowed))
    tokens = materialize(_member_tokens(docs, narrowed, width, doc_id, text))
    links = cell_links(narrowed.select("node", "n", "cell", "is_small"), prefix, tokens, percent)
    # one id with different texts joins their classes
    ids = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "sig", "sig2")
    mark = F.struct("sig", "sig2")
    several = materialize(ids.groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("z")).where("a < z").select("doc_id"))
    if not several.isEmpty():
        named = materialize(ids.join(several, "doc_id").join(keys, ["sig", "sig2"]).select("doc_id", "node").distinct())
        links = links.union(named.join(named.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
    part = materialize(components(links))
    # only classes that are linked, or are those of several rows, have another id than their rows
    linked = classes.select("sig", "sig2", "node", "k", "first_id").join(part, "node", "left").where("k > 1 OR component IS NOT NULL")
    linked = materialize(linked.withColumn("component", F.coalesce("component", "node")).select("sig", "sig2", "component", "first_id"))
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answer = materialize(linked.join(smallest, "component").select("sig", "sig2", "component_id"))
    discard_since(before, sets, answer)
    return sets.join(checked_broadcast(answer), ["sig", "sig2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
