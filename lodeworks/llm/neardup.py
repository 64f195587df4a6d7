"""Near-duplicate texts: all pairs whose word sets agree in a given share, exactly, without comparing all pairs.

Words are ordered from rare to frequent. Two sets that agree enough share a word among the first few of each
(the prefix), and their next shared words follow within what slack is left. A record is therefore filed under
its prefix words; where a word is shared by too many records, under its pairs with the next words instead,
then triples, and so on: the upper levels of a signature tree, whose nodes are split where the data is dense.
Below them the records of one signature form a tree whose nodes hold OR- and AND-combined word bitmaps, size
ranges and the most words a record can still share; pairs of nodes are traversed from the roots down to the
records, and a pair is dropped where the largest possible overlap of its records is too small. No pair is
compared outside of that traversal. What remains is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.session import dropped, written

#: Least similarity as a fraction: 7 / 10.
NUM, DEN = 7, 10
#: A word is frequent above this share of the records, a deeper signature dense above the other; both within bounds.
WORD_SHARE, NODE_SHARE, LEAST_DENSE, MOST_WORD, MOST_NODE = 50, 100, 64, 20_000, 4_000
#: Bound of the dense signatures of one level that come to the driver; beyond it the share is halved. They are sent to
#: the tasks as a filter of at most so many bits.
MAX_DENSE, MAX_FILTER_BITS = 1_000_000, 1 << 26
#: The last level of signatures.
MAX_LEVELS = 8
#: Children of a node, and pairs of nodes that are taken at once.
FANOUT, FRONTIER = 8, 20_000
#: Ids of one class that stand under one key where they are paired.
BLOCK = 2_000

_SALT = np.uint64(0x9E3779B97F4A7C15)
_FILED = ["sig", "rid", "size", "cap", "b0", "b1"]


def words(text: Column) -> Column:
    """Distinct words: unbroken runs of letters and digits, letter case ignored."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def findings(*tables: DataFrame) -> DataFrame:
    """(id, text): finding_id and summary of the findings of all tables; rows without an id or a word are left out."""
    out = None
    for df in tables:
        own = df.select(F.explode("findings").alias("f")).select(F.col("f.finding_id").alias("id"), F.col("f.summary").alias("text"))
        out = own if out is None else out.unionByName(own)
    return out.filter("id is not null and text is not null").filter(F.size(words(F.col("text"))) > 0)


def set_key(text: Column) -> Column:
    """A 128-bit key of the word set."""
    return F.unhex(F.md5(F.array_join(F.array_sort(words(text)), " ")))


def keyed(records: DataFrame) -> DataFrame:
    """(id, key, text): the ``records`` (id, text) with the key of their word set."""
    return records.select("id", set_key(F.col("text")).alias("key"), "text")


def classes(keyed: DataFrame) -> DataFrame:
    """(rid, key, first, last, text, w): one row for each distinct word set, with the smallest and largest id that has it.

    ``rid`` is a number of the row, unique as one id may have several word sets. It holds once the table is written.
    """
    one = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("text").alias("text"))
    return one.select(F.monotonically_increasing_id().alias("rid"), "key", "first", "last", "text", word_hashes(F.col("text")).alias("w"))


def class_members(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(rid, id) of the written classes ``sets`` that have more than one id."""
    return keyed.select("id", "key").join(sets.filter("first <> last").select("key", "rid"), "key").select("rid", "id").distinct()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ordered:
    """Word hashes of a batch of records, each record's from rare to frequent.

    Hashes have 32 bits. Two words of a record that share one stay two elements, so sizes are exact and what
    records share in hashes is never less than what they share in words.
    """

    def __init__(self, lists: pa.ListArray, frequent: np.ndarray, counts: np.ndarray, num: int, den: int):
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint32)
        self.start = offsets[:-1] - offsets[0]
        self.size = np.diff(offsets)
        record = np.repeat(np.arange(len(self.size)), self.size)
        key = self.values.astype(np.int64)
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, self.values), len(frequent) - 1)
            key += np.where(frequent[place] == self.values, counts[place], 0) << np.int64(32)
        self.words = self.values[np.lexsort((key, record))].astype(np.uint64)
        self.need = -(-num * self.size // den)

    def bitmaps(self) -> np.ndarray:
        """128 bits a record, one set for each word."""
        bit = _mix(self.values.astype(np.uint64) + _SALT) & np.uint64(127)
        one = np.uint64(1) << (bit & np.uint64(63))
        high = bit > np.uint64(63)
        halves = [np.where(high, np.uint64(0), one), np.where(high, one, np.uint64(0))]
        return np.column_stack([np.bitwise_or.reduceat(h, self.start) if len(self.start) else h for h in halves])

    def signatures(self, dense: list[np.ndarray], only_level: int | None = None, giant: list[np.ndarray] | None = None, blocks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(record, signature, cap) under which the records are filed; with ``only_level``, all of that level instead.

        ``cap`` is the most words that a record can share with another of the node: those of the signature and
        those that follow. ``dense`` and ``giant`` hold hash filters of the dense and the giant signatures by level.
        A record that need not agree on more words than a level has is filed at that level even if the signature is
        dense, and so is every record at the last level. A giant one is then split into ``blocks``: a record is filed
        for every pair of blocks that its own belongs to, so any two still meet.
        """
        record = np.arange(len(self.size))
        at, left, sig = np.zeros_like(record), self.size - self.need, np.zeros(len(record), dtype=np.uint64)
        out: list[tuple] = []
        for level in range(1, MAX_LEVELS + 1):
            parts: list[tuple] = []
            for skip in range(int(left.max(initial=-1)) + 1):
                ok = (skip <= left) & (at + skip < self.size[record])
                r, p = record[ok], at[ok] + skip
                parts.append((r, p + 1, left[ok] - skip, _mix(sig[ok] * np.uint64(3) + self.words[self.start[r] + p] + _SALT)))
            if not parts:
                break
            record, at, left, sig = (np.concatenate(c) for c in zip(*parts, strict=True))
            cap = level + self.size[record] - at
            if level == only_level:
                return record, sig, cap
            more = among(sig, dense[level - 1]) if level <= len(dense) else np.zeros(len(sig), dtype=bool)
            final = ~more | (self.need[record] <= level) | (level == MAX_LEVELS)
            split = final & more & among(sig, giant[level - 1]) if giant and blocks > 1 and level <= len(giant) else np.zeros(len(sig), dtype=bool)
            out.append((record[final & ~split], sig[final & ~split], cap[final & ~split]))
            if split.any():
                out.append(self._blocks(record[split], sig[split], cap[split], blocks))
            record, at, left, sig = record[more], at[more], left[more], sig[more]
            if not len(record):
                break
        if only_level is not None or not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        record, sig, cap = (np.concatenate(c) for c in zip(*out, strict=True))
        return record, sig, cap

    def _blocks(self, record, sig, cap, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sums = np.add.reduceat(_mix(self.values.astype(np.uint64)), self.start) if len(self.start) else np.zeros(0, dtype=np.uint64)
        own = np.repeat(sums[record] % np.uint64(blocks), blocks)
        other = np.tile(np.arange(blocks, dtype=np.uint64), len(record))
        pair = np.minimum(own, other) * np.uint64(blocks) + np.maximum(own, other)
        return np.repeat(record, blocks), _mix(np.repeat(sig, blocks) + _mix(pair + _SALT)), np.repeat(cap, blocks)


def level_one(word_hash: np.ndarray) -> np.ndarray:
    """The signature of a single word."""
    return _mix(word_hash.astype(np.uint64) + _SALT)


def hash_filter(sigs: np.ndarray) -> np.ndarray:
    """A bit for each signature, in 64-bit words; their number is a power of two and has a bound.

    A signature that only seems to be in it is taken as dense by all records alike, which costs a level more and
    loses nothing.
    """
    bits = 1 << 12
    while bits < min(64 * len(sigs), MAX_FILTER_BITS):
        bits *= 2
    out = np.zeros(bits // 64, dtype=np.uint64)
    place = sigs & np.uint64(bits - 1)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out if len(sigs) else out[:0]


def among(sigs: np.ndarray, held: np.ndarray) -> np.ndarray:
    """True for the signatures that are in a ``hash_filter``."""
    if not len(held):
        return np.zeros(len(sigs), dtype=bool)
    place = sigs & np.uint64(64 * len(held) - 1)
    return held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of each bitmap."""
    n = np.bitwise_count(x)
    return n[..., 0].astype(np.int32) + n[..., 1]


class SignatureForest:
    """One signature tree for each run of equal signatures; all trees are built and traversed together.

    Records, the leaves, stand in order of ``cap`` and size. A node combines FANOUT children: the range of their
    sizes, their largest cap, their bitmaps by OR and by AND, and the most bits that words of one record share
    (``slack``). The dual traversal takes pairs of nodes of one level, starting with each root and itself, drops
    those whose records cannot agree enough (``possible``), and goes on with the pairs of the children of the rest.
    ``tested`` and ``kept`` count the pairs of each level, 0 being the records.
    """

    def __init__(self, sig: np.ndarray, size: np.ndarray, cap: np.ndarray, bitmap: np.ndarray, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        self.order = np.lexsort((size, cap, sig))
        sig, size, cap, bitmap = sig[self.order], size[self.order].astype(np.int32), cap[self.order].astype(np.int32), np.ascontiguousarray(bitmap[self.order])
        self.levels = [{"low": size, "high": size, "cap": cap, "slack": size - _bits(bitmap), "any": bitmap, "all": bitmap}]
        while len(sig) and (len(self.levels) == 1 or (sig[1:] == sig[:-1]).any()):
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            place = np.arange(len(sig)) - np.repeat(starts, np.diff(np.r_[starts, len(sig)]))
            self._combine(np.flatnonzero(place % FANOUT == 0))
            sig = sig[place % FANOUT == 0]
        self.tested, self.kept = [0] * len(self.levels), [0] * len(self.levels)

    def _combine(self, cuts: np.ndarray) -> None:
        below = self.levels[-1]
        self.levels.append({
            "low": np.minimum.reduceat(below["low"], cuts), "high": np.maximum.reduceat(below["high"], cuts),
            "cap": np.maximum.reduceat(below["cap"], cuts), "slack": np.maximum.reduceat(below["slack"], cuts),
            "any": np.bitwise_or.reduceat(below["any"], cuts, axis=0), "all": np.bitwise_and.reduceat(below["all"], cuts, axis=0),
            "first": cuts, "count": np.diff(np.r_[cuts, len(below["low"])]),
        })

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the node pairs (a, b) of a level in which some two records may agree in num / den.

        Two records of n and m words need num / (num + den) of n + m words in common. They have at most cap in
        common, at most the bits of both and slack, and at most n less the bits that the other cannot have.
        """
        at, num, den = self.levels[level], self.num, self.den
        both = num + den
        low_a, low_b = at["low"][a], at["low"][b]
        need = num * (low_a + low_b)
        kept = np.flatnonzero(np.minimum(at["cap"][a], at["cap"][b]) * both >= need)
        if level:
            kept = kept[den * np.minimum(at["high"][a[kept]], at["high"][b[kept]]) >= num * np.maximum(low_a[kept], low_b[kept])]
        a, b, need = a[kept], b[kept], need[kept]
        any_a, any_b = at["any"].take(a, axis=0), at["any"].take(b, axis=0)
        # between two records this is all that bitmaps say: what a record has and the other has not is its size less this
        ok = (np.minimum(at["slack"][a], at["slack"][b]) + _bits(any_a & any_b)) * both >= need
        if level:
            lost_a, lost_b = _bits(at["all"][a] & ~any_b), _bits(at["all"][b] & ~any_a)
            ok &= (den * at["high"][a] - num * at["low"][b] >= both * lost_a) & (den * at["high"][b] - num * at["low"][a] >= both * lost_b)
        return kept[ok]

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, count = self.levels[level]["first"], self.levels[level]["count"]
        n = count[a] * count[b]
        pair = np.repeat(np.arange(len(a)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        i, j = first[a][pair] + place // count[b][pair], first[b][pair] + place % count[b][pair]
        own = (a[pair] != b[pair]) | ((i < j) if level == 1 else (i <= j))
        return i[own], j[own]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of the records that may agree enough, each pair of a run once."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["low"]))
        self.tested[top], kept = len(roots), self.possible(top, roots, roots)
        self.kept[top] = len(kept)
        stack = [(top, roots[kept], roots[kept])] if top else []
        out_i, out_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                stack += [(level, a[x : x + FRONTIER], b[x : x + FRONTIER]) for x in range(0, len(a), FRONTIER)]
                continue
            i, j = self._children(level, a, b)
            kept = self.possible(level - 1, i, j)
            self.tested[level - 1] += len(i)
            self.kept[level - 1] += len(kept)
            if level > 1 and len(kept):
                stack.append((level - 1, i[kept], j[kept]))
            elif level == 1:
                out_i.append(i[kept])
                out_j.append(j[kept])
        return self.order[np.concatenate(out_i)], self.order[np.concatenate(out_j)]


def group_pairs(sig: np.ndarray, rid: np.ndarray, size: np.ndarray, cap: np.ndarray, bitmap: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller rid first, each once) within runs of equal ``sig``."""
    i, j = SignatureForest(sig, size, cap, bitmap, num, den).pairs()
    a, b = rid[i], rid[j]
    both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)])[a != b], axis=0)
    return both[:, 0], both[:, 1]


def _threshold(n: int, share: int, most: int) -> int:
    return min(max(LEAST_DENSE, n // share), most)


def _column(df: DataFrame, limit: int) -> pa.Table | None:
    """The rows of ``df`` as one Arrow table, or None where it has more than ``limit``."""
    rows = df.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit else None


def _dense_words(hashed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of records) of the frequent words by hash; where they exceed their bound, of those twice as frequent."""
    counted = hashed.select(F.explode("w").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    limit = _threshold(n, WORD_SHARE, MOST_WORD)
    while (rows := _column(counted.filter(F.col("n") > limit), MAX_DENSE)) is None:
        limit *= 2
    h = rows.column("h").to_numpy().astype(np.int32).view(np.uint32)
    order = np.argsort(h)
    return h[order], rows.column("n").to_numpy()[order]


def word_hashes(text: Column) -> Column:
    """32-bit hashes of the distinct words, as many as there are words."""
    return F.transform(words(text), lambda w: F.hash(w))


def candidate_pairs(records: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b) with a < b of the ``records`` (rid, w: hashes of the words) that may agree in num / den; a superset."""
    hashed = records.select("rid", "w")
    n = records.count()
    frequent, counts = _dense_words(hashed, n)
    limit = _threshold(n, NODE_SHARE, MOST_NODE)
    dense, giant = [hash_filter(level_one(frequent))], [hash_filter(level_one(frequent[counts > 4 * MOST_NODE]))]
    most = int(counts.max(initial=0))

    def count_level(level: int, known: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, sig, _ = Ordered(batch.column(1), frequent, counts, num, den).signatures(known, level)
                sig, k = np.unique(sig, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(k)], names=["sig", "n"])

        return run

    while len(dense[-1]) and len(dense) < MAX_LEVELS:
        counted = hashed.mapInArrow(count_level(len(dense) + 1, list(dense)), "sig bigint, n bigint").groupBy("sig").agg(F.sum("n").alias("n"))
        own = limit
        while (rows := _column(counted.filter(F.col("n") > own), MAX_DENSE)) is None:
            own *= 2
        sig, k = rows.column("sig").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        dense.append(hash_filter(sig))
        giant.append(hash_filter(sig[k > 4 * MOST_NODE]))
        most = max(most, int(k.max(initial=0)))
    blocks = -(-most // MOST_NODE)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Ordered(batch.column(1), frequent, counts, num, den)
            record, sig, cap = own.signatures(dense, giant=giant, blocks=blocks)
            rid = batch.column(0).to_numpy()[record]
            bits = own.bitmaps()[record].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig.view(np.int64)), pa.array(rid), pa.array(own.size[record].astype(np.int32)), pa.array(cap.astype(np.int32)), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                names=_FILED,
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, rows
            sig, rid, size, cap, b0, b1 = cols = [np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(len(_FILED))]
            end = len(sig) if last else int(np.searchsorted(sig, sig[-1], side="left"))
            held = [] if last else [pa.RecordBatch.from_arrays([pa.array(c[end:]) for c in cols], names=_FILED)]
            rows = len(sig) - end
            bits = np.column_stack([b0[:end], b1[:end]]).view(np.uint64)
            a, b = group_pairs(sig[:end], rid[:end], size[:end], cap[:end], bits, num, den)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        threshold = 200_000
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > threshold:
                yield flush(False)
                threshold = max(200_000, 2 * rows)
        if held:
            yield flush(True)

    filed = hashed.mapInArrow(file, "sig bigint, rid bigint, size int, cap int, b0 bigint, b1 bigint")
    return filed.repartition("sig").sortWithinPartitions("sig").mapInArrow(join, "a bigint, b bigint").distinct()


def similar_pairs(records: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, first_a, last_a, first_b, last_b) of the ``records`` (rid, first, last, text, w) whose words agree, verified on the words.

    Each side of a candidate fetches its text by one join; the two sides then meet by the pair.
    """
    found = candidate_pairs(records.select("rid", "w"), num, den)
    sides = found.select("a", "b", F.explode(F.array("a", "b")).alias("rid")).join(records.select("rid", "first", "last", "text"), "rid")
    own = F.struct("rid", "first", "last", "text")
    both = sides.groupBy("a", "b").agg(F.min(own).alias("x"), F.max(own).alias("y")).filter("x.rid < y.rid")
    wa, wb = words(F.col("x.text")), words(F.col("y.text"))
    agree = F.size(F.array_intersect(wa, wb)) * (den + num) >= num * (F.size(wa) + F.size(wb))
    return both.filter(agree).select("a", "b", *(F.col(f"{x}.{c}").alias(f"{c}_{side}") for x, side in (("x", "a"), ("y", "b")) for c in ("first", "last")))


def within_classes(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a_id, b_id) with a_id < b_id: all pairs of ids of one class of ``members`` (rid, id).

    A class of more than ``block`` ids is cut into blocks, and each pair of blocks is a key of its own.
    """
    large = members.groupBy("rid").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("rid", F.ceil(F.col("n") / block).alias("blocks"))
    cut = members.join(large, "rid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    left = cut.select("rid", F.col("id").alias("a_id"), F.col("own").alias("x"), every.alias("y"))
    right = cut.select("rid", F.col("id").alias("b_id"), F.col("own").alias("y"), every.alias("x"))
    return left.join(right, ["rid", "x", "y"]).filter("a_id < b_id").select("a_id", "b_id")


def finding_pairs(*tables: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(finding_a, finding_b), smaller first: all pairs of different ids whose summaries agree.

    A finding_id delivered again counts once; one whose deliveries differ counts with each of its texts.
    Summaries that are null, empty or without a word are left out. Every pair within a class of equal word
    sets is given too.
    """
    records = written(keyed(findings(*tables)), "findings")
    sets = written(classes(records), "finding-classes")
    pairs = written(similar_pairs(sets, num, den), "finding-pairs")
    members = class_members(records, sets)
    of = lambda side: members.select(F.col("rid").alias(side), F.col("id").alias(f"{side}_id"))
    single = pairs.filter("first_a = last_a and first_b = last_b").select(F.col("first_a").alias("a_id"), F.col("first_b").alias("b_id"))
    several = (
        pairs.filter("first_a <> last_a or first_b <> last_b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        .select(F.coalesce("a_id", "first_a").alias("a_id"), F.coalesce("b_id", "first_b").alias("b_id"))
    )
    out = single.unionByName(several).unionByName(within_classes(members))
    return out.select(F.least("a_id", "b_id").alias("finding_a"), F.greatest("a_id", "b_id").alias("finding_b")).filter("finding_a <> finding_b").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, group): connected components of ``edges`` (a, b), named by their smallest node.

    Each round a node, and the node that its label names, take the smallest label of the labels of its neighbours,
    so whole regions are hooked at once and rounds grow with the logarithm of the size. Rounds end when no
    label changes; if ``rounds`` do not suffice, that is an error. Every round is written to the shared folder,
    and removed when the next one is.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("group")), "labels")
    for _ in range(rounds):
        jump = labels.select(F.col("node").alias("group"), F.col("group").alias("far"))
        far = labels.join(jump, "group").select("node", F.col("group").alias("old"), "far")
        seen = both.join(far.select(F.col("node").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("near"))
        lower = far.join(seen, far["node"] == seen["a"]).select("node", "old", "far", "near")
        hooks = lower.groupBy(F.col("old").alias("node")).agg(F.min("near").alias("hook"))
        after = written(lower.join(hooks, "node", "left").select("node", "old", F.least("far", "near", "hook").alias("group")), "labels")
        dropped(labels)
        labels = after.select("node", "group")
        if not after.filter("group <> old").limit(1).count():
            dropped(both)
            return labels
    raise RuntimeError(f"connected components did not settle in {rounds} rounds")


def finding_groups(*tables: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(finding_id, class_id, links, group_id), one row for each finding_id with a word.

    A finding_id whose deliveries differ stands in the class of its smallest text, and binds the classes of its
    other texts to its group. ``class_id`` is the smallest finding_id that stands in the class, ``links`` the number
    of other word sets that agree with it, ``group_id`` the smallest class_id of its connected component.
    Copies are not expanded into pairs.
    """
    records = written(keyed(findings(*tables)), "findings")
    sets = written(classes(records), "finding-classes")
    pairs = written(similar_pairs(sets, num, den).select("a", "b"), "finding-pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    keys = sets.select("key", "rid")
    of_id = records.groupBy("id").agg(F.min(F.struct("text", "key")).alias("least"), F.count_distinct("key").alias("keys"))
    edited = of_id.filter("keys > 1").select("id").join(records.select("id", "key").distinct(), "id").join(keys, "key")
    bound = edited.join(edited.groupBy("id").agg(F.min("rid").alias("a")), "id").filter("a <> rid").select("a", F.col("rid").alias("b"))
    standing = of_id.select("id", "least.key").join(keys, "key")
    named = (
        standing.groupBy("rid").agg(F.min("id").alias("class_id")).join(links, "rid", "left")
        .join(components(pairs.unionByName(bound)).withColumnRenamed("node", "rid"), "rid", "left").withColumn("group", F.coalesce("group", "rid"))
    )
    groups = named.groupBy("group").agg(F.min("class_id").alias("group_id"))
    return standing.join(named.join(groups, "group"), "rid").select(F.col("id").alias("finding_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "group_id")
