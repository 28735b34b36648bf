"""Byte-level BPE encoding and decoding.

``encode_documents`` folds ranked merges over the bytes of distinct words in
Arrow batches; ``encode_documents_native`` does the same in Spark's
higher-order functions and costs several times as much (see the README).

In the native form ranked merges are folded over the bytes of a word by ``aggregate``; the ranks
are a literal map, laid out as an array that a collision-free hash of the two
token ids addresses, because looking up a Spark map is a linear scan.  Words
that are frequent in a bounded sample are folded once, as distinct words, and
kept in a literal word map; every other word is folded where it occurs, by the
same expression.  So the word map changes the cost and never the result.
Decoding maps ids to byte pieces and concatenates these.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.llm.common import sliced

#: No merge: greater than every rank.
NONE = 1 << 30
#: Multipliers of the pair hash; a pair is below 2**32, so products stay below 2**63.
SPREAD, DEAL = 1_640_531_527, 1_013_904_223


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a tiktoken rank file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Displacements, keys and merged ids of a collision-free table over pairs of token ids."""
    pairs: dict[int, int] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left * 65536 + right] = rank
    keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
    size = int(len(keys) * 1.35) | 1
    while any(size % p == 0 for p in range(3, int(size**0.5) + 1, 2)):
        size += 2
    groups = max(1, len(keys) // 3)
    base, group = keys * SPREAD % size, keys * DEAL % groups
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=groups))
    taken = np.zeros(size, dtype=bool)
    displace, slot_key, slot_id = [0] * groups, [-1] * size, [NONE] * size
    members = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for own in sorted(members, key=len, reverse=True):
        move = 0
        while True:
            slots = (base[own] + move) % size
            if not taken[slots].any() and len(set(slots.tolist())) == len(own):
                break
            move += 1
            if move >= size:
                raise ValueError("no collision-free table for these ranks")
        taken[slots] = True
        displace[int(group[own[0]])] = move
        for place, at in zip(slots.tolist(), own.tolist(), strict=True):
            slot_key[place], slot_id[place] = int(keys[at]), pairs[int(keys[at])]
    return displace, slot_key, slot_id


def _literal(values, kind: str) -> Column:
    """A literal of a compound type: the parser's constant result."""
    return F.from_json(F.lit(json.dumps({"v": values}, ensure_ascii=False, separators=(",", ":"))), f"struct<v:{kind}>")["v"]


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-split pattern.

    ``pattern`` is a pattern in the dialect that Java and tiktoken share; it is
    matched with Unicode character classes.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        if len(self.ranks) > 65536:
            raise ValueError("token ids must be below 65536")
        self.pattern = "(?U)" + pattern
        displace, keys, ids = _pair_table(self.ranks)
        self.groups, self.size = len(displace), len(keys)
        single = [self.ranks[bytes([b])] for b in range(256)]
        self._merge_table = F.struct(
            _literal(displace, "array<int>").alias("d"),
            _literal(keys, "array<bigint>").alias("k"),
            _literal(ids, "array<int>").alias("v"),
            _literal(single, "array<int>").alias("b"),
        )
        pieces: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.hex()
        self._pieces = pieces

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def _fold(self, word: Column, t: Column) -> Column:
        """ids of one word; ``t`` is the merge table."""
        size, groups = self.size, self.groups

        def rank(a: Column, b: Column) -> Column:
            def found(key: Column) -> Column:
                place = (key * SPREAD % size + F.get(t["d"], (key * DEAL % groups).cast("int"))) % size
                return F.get(
                    F.transform(
                        F.array(place.cast("int")),
                        lambda s: F.when(F.get(t["k"], s) == key, F.get(t["v"], s)).otherwise(NONE),
                    ),
                    F.lit(0),
                )

            return F.get(F.transform(F.array(a.cast("bigint") * 65536 + b), found), F.lit(0))

        letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        start = F.transform(letters, lambda c: F.get(t["b"], F.ascii(c)))

        def ranks_of(tokens: Column) -> Column:
            return F.transform(
                F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
                lambda a, i: rank(a, F.get(tokens, i + 1)),
            )

        def merge(state: Column, _: Column) -> Column:
            def at(best: Column) -> Column:
                def apply(p: Column) -> Column:
                    tokens, ranks = state["t"], state["r"]
                    n = F.size(tokens)
                    none = F.slice(ranks, 1, 0)
                    return F.struct(
                        F.concat(F.slice(tokens, F.lit(1), p - 1), F.array(best), F.slice(tokens, p + 2, n)).alias("t"),
                        F.concat(
                            F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))),
                            F.when(p > 1, F.array(rank(F.get(tokens, p - 2), best))).otherwise(none),
                            F.when(p + 1 < n, F.array(rank(best, F.get(tokens, p + 1)))).otherwise(none),
                            F.slice(ranks, p + 2, n),
                        ).alias("r"),
                    )

                place = F.array_position(state["r"], best).cast("int")
                return F.get(F.transform(F.array(place), apply), F.lit(0))

            best = F.array_min(state["r"])
            return F.when(
                F.coalesce(best, F.lit(NONE)) >= NONE, state
            ).otherwise(F.get(F.transform(F.array(best), at), F.lit(0)))

        def run(tokens: Column) -> Column:
            first = F.struct(tokens.alias("t"), ranks_of(tokens).alias("r"))
            return F.aggregate(F.sequence(F.lit(1), F.size(tokens)), first, merge, lambda s: s["t"])

        return F.get(F.transform(F.array(start), run), F.lit(0))

    def encode_word(self, word: Column) -> Column:
        """array<int> of token ids of one word (a match of the pattern)."""
        return F.get(F.transform(F.array(self._merge_table), lambda t: self._fold(word, t)), F.lit(0))

    def word_map(self, docs: DataFrame, text: str, words: int, sample_docs: int) -> Column | None:
        """Literal hash table of up to ``words`` distinct words with their ids.

        The words are the most frequent in about ``sample_docs`` documents, so
        the literal is of bounded size whatever the corpus is.
        """
        total = docs.count()
        if not total or not words:
            return None
        share = max(1, total // sample_docs)
        picked = docs.where(F.pmod(F.xxhash64(F.substring(F.col(text), 1, 64)), F.lit(share)) == 0)
        places = words * 2
        slot = F.pmod(F.xxhash64("w"), F.lit(places)).cast("int")
        counted = (
            picked.select(F.explode(self.words(F.col(text))).alias("w"))
            .groupBy("w").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1 and length(w) < 64")
            .orderBy(F.desc("n"), "w").limit(words)
            .groupBy(slot.alias("slot")).agg(F.max_by("w", F.struct("n", "w")).alias("w"))
        )
        spread = counted.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2)
        rows = spread.select("slot", "w", self.encode_word(F.col("w")).alias("i")).toArrow().to_pydict()
        table: list = [None] * places
        for place, word, ids in zip(rows["slot"], rows["w"], rows["i"], strict=True):
            table[place] = {"w": word, "i": ids}
        return _literal(table, "array<struct<w:string,i:array<int>>>")

    def encode(self, text: Column, word_map: Column | None = None, places: int = 0) -> Column:
        """array<int> of token ids of a text."""

        def each(t: Column, m: Column | None) -> Column:
            def ids(word: Column) -> Column:
                if m is None:
                    return self._fold(word, t)
                return F.get(
                    F.transform(
                        F.array(F.get(m, F.pmod(F.xxhash64(word), F.lit(places)).cast("int"))),
                        lambda e: F.when(F.coalesce(e["w"] == word, F.lit(False)), e["i"]).otherwise(self._fold(word, t)),
                    ),
                    F.lit(0),
                )

            return F.flatten(F.transform(self.words(text), ids))

        tables = [self._merge_table.alias("t")] + ([word_map.alias("m")] if word_map is not None else [])
        return F.get(
            F.transform(F.array(F.struct(*tables)), lambda s: each(s["t"], s["m"] if word_map is not None else None)),
            F.lit(0),
        )

    def decode(self, ids: Column) -> Column:
        """binary: the byte pieces of the ids, concatenated."""
        pieces = _literal(self._pieces, "array<string>")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))

    def packed(self, ids: Column) -> Column:
        """binary: the ids as little-endian unsigned 32-bit integers."""
        words = _literal([i.to_bytes(4, "little").hex() for i in range(len(self._pieces))], "array<string>")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(words, i)), ""))


def encode_documents_native(
    docs: DataFrame, path: str, pattern: str, *, text: str = "text",
    map_words: int = 131072, sample_docs: int = 8192,
) -> DataFrame:
    """As ``encode_documents``, in higher-order functions alone; an unbroken word of n bytes takes n steps of O(n)."""
    bpe = ByteBpe(path, pattern)
    held = bpe.word_map(docs, text, map_words, sample_docs)
    out = docs.withColumn("ids", bpe.encode(F.coalesce(F.col(text), F.lit("")), held, map_words * 2))
    return out.withColumn("packed", bpe.packed(F.col("ids"))).withColumn("decoded", bpe.decode(F.col("ids")))


#: Where a cut before a single space might change the words: next to other white space.
UNSAFE = re.compile(r" \s|\s ")
#: Distinct words whose ids a worker keeps; when full it starts anew.
KEPT = 150_000


class WordFolder:
    """Encodes texts by their distinct words: each is folded once by rank and kept, bounded in number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        white = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(white).findall
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def fold(self, word: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self._fold_long(parts)
        found = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (least := min(found)) < NONE:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1], NONE)
        return [ranks[p] for p in parts]

    def _fold_long(self, parts: list[bytes]) -> list[int]:
        """The same order of merges with a heap over a linked list, for unbroken runs of any length."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            k = before[i]
            if k >= 0 and (r := ranks.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[i]))
        return [ranks[p] for p, live in zip(parts, alive, strict=True) if live]

    def _packed_word(self, word: str) -> bytes:
        kept = self.words.get(word)
        if kept is None:
            ids = self.fold(word.encode())
            kept = b"".join([i.to_bytes(4, "little") for i in ids])
            if len(word) < 64:
                if len(self.words) > KEPT:
                    self.words.clear()
                self.words[word] = kept
        return kept

    def packed(self, text: str) -> bytes:
        """ids of a text as little-endian unsigned 32-bit integers."""
        if UNSAFE.search(text):
            return b"".join(map(self._packed_word, self.split(text)))
        # a single space between other characters always begins a word
        first, *rest = text.split(" ")
        spaced = self.spaced
        if len(spaced) > KEPT:
            spaced.clear()
        for part in set(rest).difference(spaced):
            spaced[part] = b"".join(map(self._packed_word, self.split(" " + part)))
        out = b"".join([*map(self._packed_word, self.split(first)), *map(spaced.__getitem__, rest)])
        if rest and max(map(len, rest)) > 256:
            for part in [x for x in spaced if len(x) > 256]:
                del spaced[part]
        return out

    def decode(self, packed: bytes) -> bytes:
        """The byte pieces of the ids, concatenated."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_folders: dict[tuple[str, str], WordFolder] = {}


def _folder(path: str, pattern: str, ranks: dict[bytes, int]) -> WordFolder:
    """The folder of this worker, whose kept words outlast a task."""
    if (path, pattern) not in _folders:
        _folders[path, pattern] = WordFolder(ranks, pattern)
    return _folders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` plus packed (binary), decoded (binary, decoded from the ids) and, if asked for, ids (array<int>).

    NULL texts are empty and give no ids and no bytes; all other columns pass
    through, but for columns of these names, which are replaced.  Repeated rows
    give repeated results; an empty table gives none.
    """
    ranks = load_ranks(path)
    names = ["packed", "decoded", *(["ids"] if ids else [])]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _folder(path, pattern, ranks)
        for batch in sliced(batches, text):
            texts = batch.column(text)
            packed = [folder.packed(x.as_py() or "") if x.is_valid else b"" for x in texts]
            columns = [pa.array(packed, pa.binary()), pa.array(map(folder.decode, packed), pa.binary())]
            if ids:
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    extra = StructType.fromDDL("packed binary, decoded binary" + (", ids array<int>" if ids else ""))
    return docs.mapInArrow(run, StructType(docs.schema.fields + extra.fields))
