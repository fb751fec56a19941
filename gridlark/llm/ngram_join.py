"""N-gram Jaccard join by T-occurrence search.

Two documents link when ``100 * |A and B| >= 80 * |A or B|`` over their sets of word shingles, so sets of n and m shingles
must share ``T = ceil(80 (n + m) / 180)`` of them. DivideSkip answers "which sets share T shingles with this one" by merging
the short inverted lists in a heap and probing the long ones for what the merge has left. Over Spark, candidates are brought
together in blocks, and a block's inverted lists answer all queries of the block:

1. Equal sets collapse to their smallest document (a digest of the set; no join of texts).
2. Shingles are ordered by hash. Of a set's first ``n - ceil(0.8 n) + 1 + c`` shingles at least ``c + 1`` must be shared with
   a partner, so documents that share fewer of them with all others together go. Most documents have no near copy and end
   here; no other document can link. Only those that are left are split into words again: to keep all sets would write more
   than the texts.
3. Of what is left, whole sets are counted. Of a set's ``n - ceil(0.8 n) + 1`` rarest shingles at least one must be shared:
   these, less those that no other document has, say where its candidates are. Common lines and passages aren't among them.
4. Rounds: one document of each of these lists (the hub: in the first round the one with fewest shingles of its own) is the
   query, the list's documents that aren't in its component are the candidates. A candidate is in the block of the hub that it
   meets in most lists. Links join components. Lists whose documents are in one component are done with.
5. When what is left is little, or a round has changed little, each document has a home: a block of documents of its
   component, or, where components are small, of documents that share their longest list. Every document asks the homes of its
   lists that have other components, as far as sizes and what is left of the shingles allow a link. So a query is sent to
   blocks, not paired with documents, also where nothing links; of two homes one asks the other, and no link is left out.

A block of a hub has about ``BLOCK`` documents, a home about ``HOME`` shingles. It has inverted lists for each class of sizes,
with the overlap T that the least of the class needs; what reaches T is a link if it reaches the overlap of its own size.

Hot shingles are summed up before they are shuffled, and their rows are spread over all tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.joins import looked_up
from gridlark.llm.tables import fold, fresh, keyed, slices, written

#: A link needs PERCENT * |A or B| <= 100 * |A and B|. The prefix reaches EXTRA percent of the set beyond the least.
PERCENT, EXTRA = 80, 5
#: Documents in a hub's block, and shingles in a home, on average. Queries aren't held: they pass by.
BLOCK, HOME = 64, 1 << 20
#: Queries that a task answers for a home at most, on average.
ASKERS = 4096
#: By how much a class of sizes may exceed its least size, in percent.
CLASS = 10
#: Rounds of hubs at most, before homes are asked. More would only save work.
ROUNDS = 6
#: Ids that are sent to all executors at most, 16 bytes each; with more of them the documents are shuffled instead.
BROADCAST_IDS = 1_000_000
#: Documents of a list that one task sends to its homes at most.
SPREAD = 1024


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` are one shingle."""
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def least_shared(n: int) -> int:
    """Prefix shingles that a set of ``n`` and a larger one must share at least to link."""
    return 1 + n * EXTRA // 100


def prefix_length(n: int) -> int:
    return min(n, n * (100 - PERCENT) // 100 + least_shared(n))


def least_overlap(n: int, m: int) -> int:
    """T: shingles that sets of n and m must share."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


# ---------------------------------------------------------------------------------------------------------- DivideSkip


def divide_skip(lists: list[list[int]], least: int, mu: float = 0.01) -> dict[int, int]:
    """Ids that occur in ``least`` or more of the ascending id lists, with their number of lists.

    The longest ``least / (mu log M + 1)`` lists are set aside. An id must be in ``least`` minus as many of the others, which
    are merged in a heap; what gets there is looked up in the long lists by binary search, as long as it can still reach
    ``least``.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least or least < 1:
        return {}
    n_long = min(least - 1, int(least / (mu * np.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found, now, count = {}, None, 0

    def probe(i: int, count: int) -> None:
        left = len(long)
        for x in long:
            if count + left < least:
                return
            at = bisect_left(x, i)
            count += at < len(x) and x[at] == i
            left -= 1
        if count >= least:
            found[i] = count

    for i in heapq.merge(*short):
        if i == now:
            count += 1
            continue
        if now is not None and count >= least - n_long:
            probe(now, count)
        now, count = i, 1
    if now is not None and count >= least - n_long:
        probe(now, count)
    return found


class Inverted:
    """Inverted lists of a block of sets: for each class of sizes, the class's shingles and, of each, the ascending positions
    of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        self.classes: list[tuple] = []
        members: list[int] = []
        for k in [*sorted(range(len(sets)), key=lambda k: (self.sizes[k], k)), None]:
            if members and (k is None or 100 * self.sizes[k] > (100 + CLASS) * self.sizes[members[0]]):
                least, most, at = self.sizes[members[0]], self.sizes[members[-1]], sorted(members)
                flat = np.concatenate([sets[i] for i in at])
                order = np.argsort(flat, kind="stable")  # positions stay ascending within a shingle
                shingles, starts = np.unique(flat[order], return_index=True)
                positions = np.repeat(at, [self.sizes[i] for i in at])[order].tolist()
                self.classes.append((least, most, shingles, [*starts.tolist(), len(positions)], positions))
                members = []
            if k is not None and self.sizes[k]:
                members.append(k)

    def search(self, query: np.ndarray) -> list[int]:
        """Positions of the sets that link to the query."""
        n, out = len(query), []
        for least, most, shingles, starts, positions in self.classes:
            if 100 * most < PERCENT * n or 100 * n < PERCENT * least:
                continue
            at = np.searchsorted(shingles, query)
            at[at == len(shingles)] = 0
            lists = [positions[starts[i] : starts[i + 1]] for i in at[shingles[at] == query].tolist()]
            found = divide_skip(lists, least_overlap(n, max(least, -(-PERCENT * n // 100))))
            out += [k for k, shared in found.items() if shared >= least_overlap(n, self.sizes[k])]
        return out


# ------------------------------------------------------------------------------------------------------------ in tasks


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        ids, n, digests, prefixes = b.column(0), [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(fold(text))
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            prefixes.append(s[: prefix_length(len(s))])
        ends = np.cumsum([0, *map(len, prefixes)])
        flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["doc_id", "n", "digest", "prefix"])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, doc, first, met) of each prefix; ``first``: of its shingle in this batch, ``met``: the batch has others."""
    for b in batches:
        prefix = b.column(1)
        tokens = prefix.flatten().to_numpy(zero_copy_only=False)
        docs = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(prefix.offsets.to_numpy()))
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        met = ~first
        met[:-1] |= ~first[1:]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens, docs, first, met)], names=["shingle", "doc", "first", "met"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingle_set(fold(t)) for t in b.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["doc", "shingles"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, asks, doc, comp, shingles) sorted by home, its documents first, then its queries, to links (a, b): of a
    query, one to each other component of its home that it links to."""
    home, index, sets, ids, comps = None, None, [], [], []
    for batch in batches:
        shingles, links = batch.column(4), []
        flat, ends = shingles.values.to_numpy(zero_copy_only=False), shingles.offsets.to_numpy()
        for k, (h, asks, doc, comp) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
            own = flat[ends[k] : ends[k + 1]]
            if h != home:
                home, index, sets, ids, comps = h, None, [], [], []
            if not asks:
                sets.append(own.copy())
                ids.append(doc)
                comps.append(comp)
                continue
            index = index or Inverted(sets)
            found = {comps[i]: ids[i] for i in index.search(own) if comps[i] != comp}
            links += [(doc, i) for i in found.values()]
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


# ------------------------------------------------------------------------------------------------------------- on Spark


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (doc, n, comp) with the components of linked documents joined under the smallest.

    Each component hooks onto its smallest linked one, chains of hooks are halved until they end, and the links between
    what is left are taken again. The tables in between lie in the shared folder.
    """
    ends = links.join(components.select(F.col("doc").alias("a"), F.col("comp").alias("u")), "a").join(components.select(F.col("doc").alias("b"), F.col("comp").alias("v")), "b")
    edges = written(_oriented(ends), "ngram-edges")
    while edges.head(1):
        hooks = written(edges.groupBy("u").agg(F.min("v").alias("root")), "ngram-hooks")
        while True:
            up = hooks.select(F.col("u").alias("root"), F.col("root").alias("above"))
            if not hooks.join(up, "root").head(1):
                break
            hooks = written(hooks.join(up, "root", "left").select("u", F.coalesce("above", "root").alias("root")), "ngram-hooks")
        components = components.join(hooks.withColumnRenamed("u", "comp"), "comp", "left").select("doc", "n", "odd", F.coalesce("root", "comp").alias("comp"))
        to = lambda c: hooks.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
        moved = edges.join(to("u"), "u", "left").join(hooks.select(F.col("u").alias("v"), F.col("root").alias("v_root")), "v", "left")
        edges = written(_oriented(moved.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))), "ngram-edges")
    return written(components, "ngram-components")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def answered(homes: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between ``queries`` (home, doc, comp) and the documents of the same home in ``homes`` (home, doc, comp)."""
    rows = homes.select("home", F.lit(False).alias("asks"), "doc", "comp").unionByName(queries.select("home", F.lit(True).alias("asks"), "doc", "comp"))
    rows = rows.join(sets, "doc").select("home", "asks", "doc", "comp", "shingles")
    return rows.repartition("home").sortWithinPartitions("home", "asks").mapInArrow(_blocks, "a long, b long")


def parted(rows: DataFrame, by: str, size: Column, most: int) -> DataFrame:
    """``rows`` (``by``, doc) with ``times``, their number with the same ``by``, and ``home``: the hash of ``by`` and of one of as
    many parts as have about ``most`` of ``size`` each. Hashes that clash would only make a larger block."""
    parts = written(rows.groupBy(by).agg(F.count(F.lit(1)).alias("times"), F.ceil(F.sum(size) / most).alias("_parts")), "ngram-parts")
    rows = looked_up(rows, parts, by, by, "times", "inner")
    return rows.withColumn("home", F.xxhash64(by, F.pmod(F.xxhash64("doc"), F.col("_parts")))).drop("_parts")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among ``pairs`` (query, doc): the candidates of a query are its blocks."""
    rows = parted(written(pairs, "ngram-asked"), "query", F.lit(1), BLOCK)
    queries = rows.select("home", F.col("query").alias("doc"), F.col("query").alias("comp")).distinct()
    return answered(rows.select("home", "doc", F.col("doc").alias("comp")), queries, sets)


def fits(n: str, m: str):
    """Sizes that allow a link."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text), which may have other columns.

    ``component_id`` is the smallest doc_id that links reach. Null, empty and blank texts have no shingles and link with
    nothing: they are their own component. Each row is a document of its own, also where ids are null or repeated: rows
    that share an id are linked by their texts alone, repeated rows come out as often as they are, and a null id takes the
    component of its copies, if any. An empty table gives an empty result.
    """
    made = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "ngram-rows")
    if made is None:
        return linked(docs)
    rows, _ = made
    found = linked(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_id")
    found = written(rows.select("_row", "doc_id").join(found, F.col("_row") == F.col("_id")).drop("_row", "_id"), "ngram-found")
    least = written(found.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")), "ngram-least")
    out = looked_up(found, least, "component_id", "component_id", "times")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def linked(docs: DataFrame) -> DataFrame:
    """``components`` of documents whose ids are neither null nor repeated."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = written(docs.mapInArrow(_prefixes, "doc_id long, n long, digest binary, prefix array<long>"), "ngram-prefixes")
    members = made.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    equal = members.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("times"))
    equal = written(equal, "ngram-equal")
    copied = written(equal.filter("times > 1"), "ngram-copied")
    copies = looked_up(members, copied, "digest", "digest", "times", "inner").filter("doc_id <> doc").select("doc_id")
    each = made.filter("n > 0").join(small(written(copies, "ngram-copies")), "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "prefix")
    shared = shared_rows(each.mapInArrow(_shared, "shingle long, doc long, first boolean, met boolean")).groupBy("doc").agg(F.count(F.lit(1)).alias("shared"))
    enough = F.col("shared") >= 1 + F.floor(F.ceil(F.col("n") * PERCENT / 100) * EXTRA / 100)
    alive = written(shared.join(members, F.col("doc") == F.col("doc_id")).filter(enough).select("doc"), "ngram-alive")
    texts = docs.withColumnRenamed("doc_id", "doc").join(small(alive), "doc", "left_semi")
    sets = written(texts.mapInArrow(_sets, "doc long, shingles array<long>"), "ngram-sets")
    lists = written(rare_lists(sets), "ngram-lists")
    comp = written(lists.groupBy("doc").agg(F.first("n").alias("n"), F.first("odd").alias("odd")).withColumn("comp", F.col("doc")), "ngram-components")
    comp = grown(comp, lists.select("shingle", "doc", "rest"), sets)

    roots = equal.join(comp.select(F.col("doc").alias("of"), F.col("comp").alias("root")), F.col("doc") == F.col("of"), "left")
    roots = written(roots.select("digest", F.coalesce("root", "doc").alias("root"), "times"), "ngram-roots")
    out = looked_up(members, roots, "digest", "digest", "times")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, sent to all executors if its rows are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shared_rows(prefixes: DataFrame) -> DataFrame:
    """(doc) for each shingle of its prefix that another document has too.

    Of a shingle, each batch sends one row at most to be counted; its other rows are known to be shared and stay.
    """
    firsts = prefixes.filter("first").select("shingle", "doc", "met").withColumn("batches", F.count(F.lit(1)).over(Window.partitionBy("shingle")))
    return prefixes.filter("not first").select("doc").unionByName(firsts.filter("met or batches > 1").select("doc"))


def rare_lists(sets: DataFrame) -> DataFrame:
    """(shingle, doc, n, rest, odd): each document's rarest shared shingles, as far as a link must lie in one.

    ``rest``: its shared shingles from this one on; ``odd``: the share of its shingles that no other has.
    """
    rows = sets.select("doc", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    frequent = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "ngram-frequent")
    own = Window.partitionBy("doc")
    rows = looked_up(rows, frequent, "shingle", "shingle", "df", "inner").withColumn("shared", F.count(F.lit(1)).over(own))
    rows = rows.filter(F.col("shared") >= F.ceil(F.col("n") * PERCENT / 100)).withColumn("place", F.row_number().over(own.orderBy("df", "shingle")))
    return rows.filter(F.col("place") <= F.col("shared") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("shingle", "doc", "n", (F.col("shared") - F.col("place") + 1).alias("rest"), (1 - F.col("shared") / F.col("n")).alias("odd"))


def grown(comp: DataFrame, lists: DataFrame, sets: DataFrame) -> DataFrame:
    """``comp`` (doc, n, odd, comp) with all links between documents of one list."""
    few, last = comp.count() <= BROADCAST_IDS, None
    sent = lambda df: F.broadcast(df) if few else df
    for turn in range(ROUNDS + 1):
        order = F.struct(F.col("odd") if turn == 0 else F.lit(0.0), F.xxhash64(F.lit(turn), "doc"))
        heads = lists.join(sent(comp), "doc").groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("doc", order).alias("query"), F.count(F.lit(1)).alias("size"))
        heads = written(heads.filter("low <> high").select("shingle", "query", "size"), "ngram-heads")
        lists = written(looked_up(lists.select("shingle", "doc", "rest"), heads, "shingle", "shingle", "size", "inner"), "ngram-open")
        within = lists.join(sent(comp), "doc").groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
        within = within.groupBy("shingle").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("inside"))
        # what is left to compare, as pairs of a list
        pairs, rows = within.agg(F.sum(F.col("size") * F.col("size") - F.col("inside")) / 2, F.sum("size")).first()
        if not rows:
            return comp
        if turn == ROUNDS or pairs <= rows or (last and pairs > 0.8 * last):
            return joined(comp, asked_homes(lists.join(sent(comp.select("doc", "comp", "n")), "doc"), sets))
        last = pairs
        hub = comp.select(F.col("doc").alias("query"), F.col("n").alias("m"), F.col("comp").alias("to"))
        asked = lists.filter("doc <> query").groupBy("doc", "query").agg(F.count(F.lit(1)).alias("meets")).join(sent(comp), "doc").join(sent(hub), "query")
        asked = asked.filter(F.col("comp") != F.col("to")).filter(fits("n", "m")).groupBy("doc").agg(F.max_by("query", F.struct("meets", "query")).alias("query"))
        comp = joined(comp, verified(asked.select("query", "doc"), sets))
    return comp


def homes_of(lists: DataFrame) -> DataFrame:
    """(doc, comp, n, times, home): one home for each document of ``lists`` (shingle, doc, size, comp, n).

    A component of at least ``BLOCK`` documents has homes of its own. Smaller ones live with others of their longest list, so
    that a list of documents that don't link has few homes, not one for each of them.
    """
    docs = lists.groupBy("doc").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.max(F.struct("size", "shingle")).alias("longest"))
    comps = docs.groupBy("comp").agg(F.count(F.lit(1)).alias("many"), F.max("longest").alias("with"))
    group = F.when(F.col("many") >= BLOCK, F.xxhash64(F.lit("comp"), "comp")).otherwise(F.xxhash64(F.lit("list"), "with.shingle"))
    docs = docs.join(comps.select("comp", group.alias("group")), "comp").select("doc", "comp", "n", "group")
    return written(parted(written(docs, "ngram-grouped"), "group", F.col("n"), HOME), "ngram-homes")


def home_queries(lists: DataFrame, homes: DataFrame) -> DataFrame:
    """(home, doc, comp): the homes that each document asks, for documents of one list and of different components.

    Of two homes the one with fewer documents of its kind asks, and each asks itself. Shingles are in one order in all sets, so
    where a pair's first common one stands, what is left on either side must reach the overlap that the pair needs.
    """
    own = lists.join(homes.select("doc", "home", F.struct("times", "home").alias("of")), "doc")
    there = own.groupBy("shingle", "home").agg(
        F.first("size").alias("size"), F.first("of").alias("to"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("left"),
    )
    # a large list is sent to its homes by several tasks
    salts = F.ceil(F.col("size") / SPREAD)
    there = there.select(F.col("shingle").alias("s"), F.col("home").alias("at"), "to", "low", "high", "least", "most", "left", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    asks = own.select("shingle", "doc", "comp", "of", "n", "rest", F.pmod(F.xxhash64("doc"), salts).alias("part"))
    sizes = 100 * F.least("n", "most") >= PERCENT * F.greatest("n", "least")
    reach = (100 + PERCENT) * F.least("left", "rest") >= PERCENT * (F.col("n") + F.col("least"))
    others = (F.col("comp") != F.col("low")) | (F.col("comp") != F.col("high"))
    meet = (F.col("shingle") == F.col("s")) & (F.col("part") == F.col("salt")) & (F.col("of") <= F.col("to")) & others & sizes & reach
    return asks.join(there, meet).select(F.col("at").alias("home"), "doc", "comp").distinct()


def asked_homes(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between documents of one list and of different components. ``lists``: (shingle, doc, size, comp, n, rest)."""
    lists = written(lists.select("shingle", "doc", "size", "comp", "n", "rest"), "ngram-ends")
    homes = homes_of(lists)
    return answered(*shared_out(homes, home_queries(lists, homes)), sets)


def shared_out(homes: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Homes and queries, with a copy of a home for each ``ASKERS`` queries, so that no task answers more for it being popular.
    Homes that nobody asks go."""
    queries = written(queries, "ngram-queries")
    copies = F.ceil(F.count(F.lit(1)) / ASKERS).alias("copies")
    copies = written(queries.groupBy("home").agg(copies, F.count(F.lit(1)).alias("times")), "ngram-copies")
    copy = lambda k: F.xxhash64("home", k).alias("home")
    homes = homes.join(copies, "home").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    queries = looked_up(queries, copies, "home", "home", "times", "inner")
    return homes.select(copy("copy"), "doc", "comp"), queries.select(copy(F.pmod(F.xxhash64("doc"), F.col("copies"))), "doc", "comp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component the row with its smallest doc_id stays.

    Where ids are null or repeated each row is a document of its own, so rows that share an id but not a text are compared
    by their own texts. A row without an id stays unless its component has another: one with an id comes first. Rows
    without words go only if they repeat an id that another row without words has. All other columns come out as they are,
    whatever their names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    made = keyed(docs, "ngram-rows")
    key = fresh("_id", docs)
    if made is None:
        ids = linked(docs).filter("component_id = doc_id").select(F.col("doc_id").alias(key))
        return docs.join(ids, F.col("doc_id") == F.col(key), "left_semi").select(columns)
    rows, row = made
    found = linked(rows.select(F.col(row).alias("doc_id"), "text")).withColumnRenamed("doc_id", "_id")
    found = rows.select(F.col(row).alias("_row"), "doc_id").join(found, F.col("_row") == F.col("_id"))
    wordless = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    group = F.when((F.col("n_shingles") > 0) | F.col("doc_id").isNull(), F.col("component_id"))
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = found.groupBy(wordless.alias("wordless"), group.alias("group")).agg(first.alias(key)).select(key)
    return rows.join(kept, F.col(row) == F.col(key), "left_semi").select(columns)


#: DuckDB SQL for ``components`` over the table documents: shingles, pairs that share one, links, and what they reach.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS seen FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.seen), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
