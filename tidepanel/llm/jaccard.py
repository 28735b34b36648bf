"""N-gram Jaccard join: documents whose word shingles are nearly the same, exactly and without pairing all.

Two sets of n tokens and similarity 4/5 share l of the first n - ceil(4n/5) + l
tokens of each, in any order common to all and for any l.  So a document with
fewer than l such tokens in common with all others together is linked with
none; of those that are left, only documents that share a token for l = 1 can
be linked.  Within these groups signature trees hold OR-combined token bitmaps and
size ranges, and a dual traversal drops pairs of nodes by their greatest
possible overlap.  Of tokens that the same documents share one is kept, and a
pair is given out at the least token of those where it meets.  What is left is
sorted out by maps of parities, whose differing bits bound the difference of
two sets from below, before whole sets are compared.  Equal sets are one class
throughout, and pairs already connected are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import forget, group_runs, release, shared_rows, sliced, stored, unused
from tidepanel.llm.components import components

N = 5
BITS, FAN = 2048, 8
#: No token.
LAST = (1 << 63) - 1
#: Members of one group that are compared in one task; a larger group is split.
BLOCK = 1024
#: Rounds in which components are joined by one pair each, before all pairs that are left are compared.
CONTRACTIONS = 3
#: Tokens of a class that go with it to each of them; a class of more is given out with another at every token where they meet.
CARRIED = 512
#: Ids that are broadcast (8 MB) to fetch their texts; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct 5-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(N, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def class_of(tokens: np.ndarray) -> int:
    """Signed 64-bit id of the class of documents with equal sets."""
    x = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return x - (1 << 64) if x >> 63 else x


def shared_at_least(n: int) -> int:
    """The l of sets of ``n`` tokens: they share so many first tokens with all others together, or are linked with none."""
    return 1 + n // 20


def prefix(tokens: np.ndarray, heavy: np.ndarray, more: int = 1) -> np.ndarray:
    """The first n - ceil(4n/5) + ``more`` tokens, those in the ascending ``heavy`` last, else by hash."""
    n = len(tokens)
    take = n - (4 * n + 4) // 5 + more
    late = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens if len(heavy) else np.zeros(n, dtype=bool)
    return np.concatenate([tokens[~late], tokens[late]])[:take]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=bool)
    bits[(tokens % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of about 4 n places (a power of two from 64 to 2**17) whether an odd number of tokens has it."""
    places = 1 << min(17, max(6, (4 * len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens % np.uint64(places)).astype(np.int64), minlength=places) & 1).view(np.uint64)


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """Whether sets of these parities, of n and m tokens, can be similar: each bit that differs is a token that only one has.

    The longer map is folded to the places of the shorter one.
    """
    places = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, places), axis=0) for x in (a, b))
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n + m


class SignatureTree:
    """Levels of nodes over members sorted by size; a node has a bitmap, a size range and what its bitmap may hide.

    ``group`` is the component of all members below a node, or -1.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray):
        hidden = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, hidden, groups)]
        while len(self.levels[-1][0]) > FAN:
            b, low, high, hide, group = self.levels[-1]
            cuts = np.arange(0, len(b), FAN)
            first, last = np.minimum.reduceat(group, cuts), np.maximum.reduceat(group, cuts)
            self.levels.append((
                np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                np.maximum.reduceat(hide, cuts), np.where(first == last, first, -1),
            ))


def tree_pairs(left: SignatureTree, right: SignatureTree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Member pairs (i < j within one tree) that the bounds leave; trees of unequal height meet at the lower one's top."""
    same = right is None
    right = left if right is None else right
    top = min(len(left.levels), len(right.levels)) - 1
    i, j = np.meshgrid(np.arange(len(left.levels[top][0])), np.arange(len(right.levels[top][0])), indexing="ij")
    i, j = i.ravel(), j.ravel()
    for level in range(top, -1, -1):
        if level < top:
            a, b = len(left.levels[level][0]), len(right.levels[level][0])
            step = np.arange(FAN)
            i = np.repeat(i[:, None] * FAN + step, FAN, axis=1).ravel()
            j = np.tile(j[:, None] * FAN + step, (1, FAN)).ravel()
            keep = (i < a) & (j < b)
            i, j = i[keep], j[keep]
        if same:
            keep = i < j if level == 0 else i <= j
            i, j = i[keep], j[keep]
        kept_i, kept_j = [], []
        for at in range(0, len(i), 65536):
            p, q = i[at : at + 65536], j[at : at + 65536]
            (b0, low0, high0, hide0, g0), (b1, low1, high1, hide1, g1) = left.levels[level], right.levels[level]
            keep = (5 * high0[p] >= 4 * low1[q]) & (5 * high1[q] >= 4 * low0[p]) & ((g0[p] != g1[q]) | (g0[p] < 0))
            p, q = p[keep], q[keep]
            most = np.bitwise_count(b0[p] & b1[q]).sum(axis=1).astype(np.int64) + np.minimum(hide0[p], hide1[q])
            most = np.minimum(most, np.minimum(high0[p], high1[q]))
            keep = 9 * most >= 4 * (low0[p] + low1[q])
            kept_i.append(p[keep])
            kept_j.append(q[keep])
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (kept_i, kept_j))
    return i, j


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def near_pairs(sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tree_pairs`` of one list sorted by size; one that fits into a node needs no levels."""
    if len(sizes) > FAN:
        _, codes = np.unique(groups, return_inverse=True)
        return tree_pairs(SignatureTree(sizes, bits, codes))
    i, j = np.triu_indices(len(sizes), 1)
    keep = (groups[i] != groups[j]) & (5 * sizes[i] >= 4 * sizes[j])
    i, j = i[keep], j[keep]
    if len(i):
        ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64) + np.minimum(sizes[i] - ones[i], sizes[j] - ones[j])
        keep = 9 * most >= 4 * (sizes[i] + sizes[j])
        i, j = i[keep], j[keep]
    return i, j


def linked(members: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets, no more than needed; (i, j) by place."""
    order = sorted(range(len(members)), key=lambda k: len(members[k]))
    sets = [members[k] for k in order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    found = near_pairs(sizes, np.stack([bitmap(s) for s in sets]), np.arange(len(sets)))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in found), strict=True):
        if (a := find(i)) != (b := find(j)) and similar(sets[i], sets[j]):
            root[b] = a
            out.append((order[i], order[j]))
    return out


def _mapped(docs: DataFrame, schema: str, row, most: int = 1 << 20) -> DataFrame:
    """``row(*columns)`` gives the rows of a document; ``docs`` has a column text."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", most):
            rows = [r for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in row(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return docs.mapInArrow(run, schema)


def _heavy_tokens(docs: DataFrame, sample: int, least: int, most: int) -> np.ndarray:
    """The ``most`` tokens most frequent among about ``sample`` documents.

    They only order tokens: any list gives the same links.
    """
    share = max(1, docs.count() // sample)
    picked = docs.where(F.pmod(F.xxhash64(F.lit(3), "row_key"), F.lit(share)) == 0)
    tokens = _mapped(picked, "t array<bigint>", lambda d, t, k: [(shingles(t).view(np.int64),)])
    counted = tokens.select(F.explode("t").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counted.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()["h"].to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def _shared(tokens: DataFrame) -> DataFrame:
    """The distinct rows (h, cid, nr) whose token several classes have."""
    dealt = tokens.select("h", "cid", "nr").repartition("h").sortWithinPartitions("h", "cid")
    return dealt.mapInArrow(lambda x: shared_rows(x, "h", "cid"), "h bigint, cid bigint, nr bigint")


def _distinct_groups(met: DataFrame) -> DataFrame:
    """Of tokens that the same classes share, the rows of one: what meets at any meets there."""
    groups = met.groupBy("h").agg(*(F.bit_xor(F.xxhash64(F.lit(k), "cid")).alias(f"x{k}") for k in (1, 2)), F.count(F.lit(1)).alias("m"))
    return met.join(groups.groupBy("x1", "x2", "m").agg(F.min("h").alias("h")).select("h"), "h")


def _meetings(met: DataFrame, signs: DataFrame, label: DataFrame, block: int, step: int) -> DataFrame:
    """(a, b): pairs of different components that the trees leave at a shared token; in a ``step`` one pair of two components at most, at a quarter of the tokens."""
    if step:
        met = met.where(F.shiftright("h", 2 * step).bitwiseAND(F.lit(3)) == 0)
    named = met.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("h", "cid", F.coalesce("component", "cid").alias("g"))
    mixed = named.groupBy("h").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y").select("h", "m")
    rest = named.join(mixed, "h").join(signs, "cid")
    # a large group is cut into runs of like size; runs meet in pairs if their sizes allow it
    place = F.row_number().over(Window.partitionBy("h").orderBy("n", "cid"))
    small = rest.where(F.col("m") <= block).withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    large = rest.where(F.col("m") > block).withColumn("run", F.floor((place - 1) / F.lit(block)).cast("int"))
    large = stored(large, "jaccard-large")
    runs = large.groupBy("h", "run").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    r0, r1 = runs.toDF("h", "i", "low0", "high0"), runs.toDF("h", "j", "low1", "high1")
    meets = r0.join(r1, "h").where("i <= j and 5 * high0 >= 4 * low1").select("h", "i", "j")
    sides = meets.select("h", "i", "j", F.col("i").alias("run"), F.lit(0).alias("side")).unionByName(
        meets.where("i < j").select("h", "i", "j", F.col("j").alias("run"), F.lit(1).alias("side"))
    )
    both = small.unionByName(large.join(sides, ["h", "run"]).drop("run"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(step)
        for part, borders in group_runs(batches, ["h", "i", "j"]):
            h, cid, n, g, side = (part.column(c).to_numpy() for c in ("h", "cid", "n", "g", "side"))
            at = part.column("ks").combine_chunks()
            begins, ks = at.offsets.to_numpy(), at.values.to_numpy()
            ks = np.where((ks >> (2 * step)) & 3 == 0, ks, LAST) if step else ks
            held: dict[int, frozenset[int]] = {}

            def tokens_of(row: int) -> frozenset[int]:
                if (c := int(cid[row])) not in held:
                    held[c] = frozenset(ks[begins[row] : begins[row + 1]].tolist()) - {LAST}
                return held[c]

            def first_at(x: int, y: int) -> bool:
                both = tokens_of(x) & tokens_of(y)
                return not both or min(both) == h[x]

            bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype=np.uint64).reshape(len(cid), -1)
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for low, high in zip(borders, borders[1:], strict=False):
                own = slice(low, high)
                middle = low + int((side[own] == 0).sum())
                if middle == high:
                    i, j = near_pairs(n[own], bits[own], g[own])
                    i, j = low + i, low + j
                else:
                    codes = np.unique(g[own], return_inverse=True)[1]
                    left = SignatureTree(n[low:middle], bits[low:middle], codes[: middle - low])
                    i, j = tree_pairs(left, SignatureTree(n[middle:high], bits[middle:high], codes[middle - low :]))
                    i, j = low + i, middle + j
                if len(i) and (not step or len(i) <= 4096):  # of more pairs a step takes one of two components anyway
                    first = [first_at(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    i, j = i[first], j[first]
                if step and len(i) > 1:
                    mixed = rng.permutation(len(i))
                    i, j = i[mixed], j[mixed]
                    named = np.stack([np.minimum(g[i], g[j]), np.maximum(g[i], g[j])])
                    once = np.unique(named, axis=1, return_index=True)[1]
                    i, j = i[once], j[once]
                ends.append((i, j))
            i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
            swap = cid[i] > cid[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            once = np.unique(np.stack([cid[i], cid[j]]), axis=1, return_index=True)[1] if len(i) else np.zeros(0, dtype=np.int64)
            columns = (cid[i[once]], cid[j[once]], np.minimum(g[i[once]], g[j[once]]), np.maximum(g[i[once]], g[j[once]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "ga", "gb"])

    ordered = both.select("h", "i", "j", "side", "n", "cid", "g", "bits", "ks").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "side", "n", "cid")
    pairs = ordered.mapInArrow(meet, "a bigint, b bigint, ga bigint, gb bigint")
    if not step:
        return pairs.select("a", "b").distinct()
    return pairs.groupBy("ga", "gb").agg(F.min(F.struct(F.xxhash64("a", "b", F.lit(step)), "a", "b")).alias("p")).select("p.a", "p.b")


def jaccard_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    sample: int = 8192, heavy_least: int = 3, heavy_most: int = 200_000, block: int = BLOCK, broadcast: int = BROADCAST_IDS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, row_key) for every row of ``docs``.

    Two documents link when 100 * intersection >= 80 * union of their distinct
    5-word shingles (fewer words: the whole sequence); component_id is the
    least id reachable.  NULL, empty and blank texts have no shingle, link
    with nothing and are components of their own.  Repeated rows and ids stay
    rows of their own; rows without an id get the component they link to
    (NULL if nobody there has an id).  Sets are compared by 64-bit hashes.
    ``class_id`` names equal sets, ``row_key`` is xxhash64(doc_id, text).
    Empty tables give no rows; other columns are not read.  ``sample``,
    ``heavy_least`` and ``heavy_most`` (frequent tokens), ``block`` (classes of
    a group in one task) and ``broadcast`` (ids) affect cost only.
    """
    key = F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key")
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), key)

    heavy = _heavy_tokens(own, sample, heavy_least, heavy_most)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in sliced(batches, "text"):
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            cids = [class_of(x) if len(x) else None for x in sets]
            first: list[np.ndarray | None] = []
            for cid, tokens in zip(cids, sets, strict=True):
                fresh = cid is not None and cid not in seen
                first.append(prefix(tokens, heavy, shared_at_least(len(tokens))).view(np.int64) if fresh else None)
                if fresh:
                    seen.add(cid)
            if len(seen) > 500_000:  # then some tokens come again
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(cids, pa.int64()), part.column("row_key"), pa.array(first, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "cid", "row_key", "p"],
            )

    rows = stored(own.mapInArrow(signatures, "doc_id bigint, n_shingles bigint, cid bigint, row_key bigint, p array<bigint>"), "jaccard-rows")
    # nr: the set's size, and in the last bit whether the token is among the first for l = 1
    n = F.col("n_shingles")
    short = n - F.floor((4 * n + 4) / F.lit(5)) + 1
    tokens = rows.where("p is not null").select("cid", n.alias("n_shingles"), short.alias("short"), F.posexplode("p").alias("at", "h"))
    rest = stored(_shared(tokens.select("h", "cid", (2 * n + (F.col("at") < F.col("short")).cast("bigint")).cast("bigint").alias("nr"))), "jaccard-shared")
    del tokens
    release(docs.sparkSession)
    before, now = None, rest.count()
    while before is None or now < 0.9 * before:
        # the least l that a document and another of at least 4/5 of its size have
        size = F.floor(F.first("nr") / F.lit(2))
        least = 1 + F.floor(F.floor((4 * size + 4) / F.lit(5)) / F.lit(20))
        able = rest.groupBy("cid").agg(F.count(F.lit(1)).alias("c"), least.alias("least")).where("c >= least").select("cid")
        old, rest = rest, stored(_shared(rest.join(able, "cid", "left_semi")), "jaccard-shared")
        forget(old)
        before, now = now, rest.count()
        release(docs.sparkSession)
    every = stored(_shared(rest.where(F.col("nr").bitwiseAND(F.lit(1)) == 1)).select("h", "cid"), "jaccard-met")
    met = stored(_distinct_groups(every), "jaccard-met")
    forget(rest, every)
    release(docs.sparkSession)
    # the sets of the classes that met another, from one document each
    named = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    wanted = stored(named.join(met.select("cid").distinct(), "cid").select("cid", "doc_id"), "jaccard-wanted")
    n_wanted = wanted.count()
    ids = wanted.select("doc_id").where("doc_id is not null").distinct()
    texts = own.join(F.broadcast(ids) if n_wanted <= broadcast else ids, "doc_id", "left_semi").unionByName(own.where("doc_id is null"))

    def held(d, t, k):
        s = shingles(t)
        return [(class_of(s), len(s), s.tobytes(), bitmap(s).tobytes(), parities(s).tobytes())] if len(s) else []

    # first contraction: each class with others that share its first shared token
    first = met.groupBy("cid").agg(F.min("h").alias("h"))
    sized = first.join(first.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("hub")), "h")
    parts = F.greatest(F.ceil(F.col("m") / F.lit(block)), F.lit(1)).cast("int")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int"))
    plan = stored(sized.select("cid", "h", "part", "m", (F.col("cid") == F.col("hub")).alias("is_hub")), "jaccard-plan")
    few = n_wanted <= broadcast
    only = plan.select("cid")
    sets = _mapped(texts, "cid bigint, n bigint, s binary, bits binary, odd binary", held)
    sets = every = stored(sets.join(F.broadcast(only) if few else only, "cid", "left_semi"), "jaccard-sets")
    if not sets.groupBy("cid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        sets = stored(sets.dropDuplicates(["cid"]), "jaccard-sets")  # of repeated rows
    release(docs.sparkSession)
    linkable = plan.where("m > 1")
    hub_parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("m") / F.lit(block)), F.lit(1)).cast("int") - 1)
    places = linkable.where("not is_hub").select("cid", "h", "part").unionByName(linkable.where("is_hub").select("cid", "h", F.explode(hub_parts).alias("part")))
    grouped = sets.select("cid", "s").join(F.broadcast(places) if few else places, "cid")

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, borders in group_runs(batches, ["h", "part"]):
            cids, texts = part.column("cid").to_numpy(), part.column("s")
            a, b = [], []
            for low, high in zip(borders, borders[1:], strict=False):
                if high - low > 1:
                    for i, j in linked([np.frombuffer(x.as_py(), dtype=np.uint64) for x in texts.slice(low, high - low)]):
                        a.append(cids[low + i])
                        b.append(cids[low + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = grouped.repartition("h", "part").sortWithinPartitions("h", "part", "cid")
    edges = stored(dealt.mapInArrow(contract, "a bigint, b bigint"), "jaccard-edges")
    release(docs.sparkSession)
    label = components(edges)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = (map(lambda x: np.frombuffer(x.as_py(), dtype=np.uint64), batch.column(c)) for c in ("oa", "ob"))
            keep = [may_link(*x) for x in zip(*odd, batch.column("na").to_pylist(), batch.column("nb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked_for: list[DataFrame] = []

    def of_pairs(pairs: DataFrame, *columns: str) -> DataFrame:
        """``pairs`` with these columns of both sets."""
        asked = stored(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), "jaccard-asked")
        own = sets.select("cid", *columns).join(F.broadcast(asked) if asked.count() <= broadcast else asked, "cid", "left_semi")
        asked_for.append(asked)
        return pairs.join(own.toDF("a", *(f"{c[0]}a" for c in columns)), "a").join(own.toDF("b", *(f"{c[0]}b" for c in columns)), "b")

    tokens_at = met.groupBy("cid").agg(F.collect_list("h").alias("ks"))
    few_at = F.when(F.size("ks") <= CARRIED, F.col("ks")).otherwise(F.array().cast("array<bigint>"))
    signs = stored(sets.select("cid", "n", "bits").join(tokens_at, "cid").withColumn("ks", few_at), "jaccard-signs")
    # what is left: tokens at which different components meet; at first one pair of each two components at a part of the
    # tokens, while that connects any, then all pairs of what is still apart
    step = 0
    while True:
        step += 1
        pairs = stored(_meetings(met, signs, label, block, step if step <= CONTRACTIONS else 0), "jaccard-pairs")
        release(docs.sparkSession)
        asked_for.clear()
        near = stored(of_pairs(pairs, "n", "odd").mapInArrow(sort_out, "a bigint, b bigint"), "jaccard-near")
        late = stored(of_pairs(near, "s").select("a", "b", "sa", "sb").mapInArrow(verify, "a bigint, b bigint"), "jaccard-late")
        forget(pairs, near, *asked_for)
        release(docs.sparkSession)
        found = not late.isEmpty()
        if found:
            label = components(label.where("node <> component").toDF("a", "b").unionByName(late))
        if step > CONTRACTIONS:
            break
        if not found:
            step = CONTRACTIONS
    forget(met, signs, sets, *([every] if every is not sets else []), plan, wanted)
    joined = label.toDF("cid", "part")
    classed = rows.join(joined, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    lowest = classed.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = classed.join(lowest, "part", "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("cid").alias("class_id"), "row_key",
    )


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the least id, NULL ids last.

    NULL, empty and blank texts all stay.  Of repeated rows one stays.  All
    columns stay as they are; empty tables stay empty.
    """
    found = stored(jaccard_components(docs, doc_id=doc_id, text=text), "jaccard-found")
    group = F.coalesce(F.col("component_id"), F.col("class_id"))
    some = found.where("n_shingles > 0")
    best = some.groupBy(group.alias("g"), F.col("component_id").isNull().alias("unnamed")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key"))["row_key"].alias("kept"), F.count(F.lit(1)).alias("n")
    )
    best = stored(best.where("n > 1").drop("n"), "jaccard-best")
    gone = some.select("row_key", group.alias("g"), F.col("component_id").isNull().alias("unnamed")).join(best, ["g", "unnamed"])
    rk = unused(docs.columns, "rk")
    gone = stored(gone.where("row_key <> kept").select(F.col("row_key").alias(rk)).distinct(), "jaccard-gone")
    keyed = docs.withColumn(rk, F.xxhash64(F.col(doc_id), F.col(text)))
    out = keyed.join(gone, rk, "left_anti")
    again = some.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row_key").alias(rk))
    if not again.isEmpty():
        again = stored(again, "jaccard-again")
        once = out.join(again, rk, "left_semi").dropDuplicates([rk])
        out = out.join(again, rk, "left_anti").unionByName(once)
    return out.select(*docs.columns)
