"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

N-grams are cut into fragments by hash.  A fragment knows in how many distinct
sets each of its n-grams occurs, so it passes on only those that two sets share;
a set of which less than the threshold is shared has no partner and goes.  An
n-gram that many sets of one batch hold is known to be shared there already: it
is common, its sets go on by any fragment, and its own fragment hears of it once
a batch.  The global order of n-grams is by class of document frequency, common
ones last, then hash.  Sets left over meet through the first of their n-grams
(prefix, size and position bounds lose no pair); overlaps of a pair are counted
fragment by fragment and summed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, map_batches, pack, small, stage, unpack, with_columns
from .components import components
from .shingles import shingle_sets

_BITS = 48
#: Sets of one batch that make an n-gram common, and the class of such n-grams.
COMMON_SETS, COMMON_CLASS = 16, 63
#: What a blob on its way to a fragment holds: postings of its range, common n-grams of its range, postings of common n-grams.
_OWN, _COMMON, _PASSING = range(3)
#: Postings that a task of the first fragments or of the regrouping holds at a time.
POSTINGS_PER_FRAGMENT = 1_500_000
#: Fragments of one set in which a pair's partial overlaps are counted.
OVERLAP_FRAGMENTS = 4
#: Rounds of leaders at most, and pairs for each posting up to which the pairs still apart are simply tried.
#: Neither bounds what is found: all pairs that stay apart are tried in the end.
ROUNDS = 6
PAIRS_PER_POSTING = 1


def _keys(sets: list[np.ndarray]) -> list[bytes | None]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def _tags(keys: list[bytes]) -> np.ndarray:
    """64 bits of each key; two sets that share them would be found out, not mixed up (see _survivors)."""
    return np.frombuffer(b"".join(k[:8] for k in keys), dtype="<u8")


def _cut(values: np.ndarray, parts: int, bits: int = _BITS) -> np.ndarray:
    """Which of so many equal ranges of the order each value falls into."""
    return ((values >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def set_members(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, key): key names the set of n-grams, null where it is empty."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(batch.column(1), n))
        return pa.record_batch(
            {
                "doc_id": batch.column(0),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "key": pa.array(_keys(sets), pa.binary()),
            }
        )

    return map_batches(with_columns(docs, ["doc_id", "text"]), one, "doc_id long, n_shingles long, key binary")


def _postings(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """(part, kind, blob): for each range of the order, a batch's n-grams and the tags of their sets; common ones apart."""
    mask = np.uint64((1 << _BITS) - 1)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = {}
        for s in shingle_sets(batch.column(0), n):
            if len(s):
                sets.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s)
        if not sets:
            return None
        each = [np.unique(s & mask) for s in sets.values()]
        grams, tags = np.concatenate(each), np.repeat(_tags(list(sets)), [len(s) for s in each])
        order = np.argsort(grams, kind="stable")
        grams, tags = grams[order], tags[order]
        begins = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        count = np.diff(np.r_[begins, len(grams)])
        often = np.repeat(count >= COMMON_SETS, count)
        out = []
        if often.any():
            common, passing = grams[begins[count >= COMMON_SETS]], _cut(tags[often], parts, 64)
            # any fragment will do for these; by tag, sets of the batch spread over all
            order = np.argsort(passing, kind="stable")
            g, t, at = grams[often][order], tags[often][order], np.searchsorted(passing[order], np.arange(parts + 1, dtype=np.uint64))
            out += [(int(p), _PASSING, pack(t[at[p] : at[p + 1]], 8) + pack(g[at[p] : at[p + 1]], 6)) for p in np.flatnonzero(np.diff(at))]
            at = np.searchsorted(_cut(common, parts), np.arange(parts + 1, dtype=np.uint64))
            out += [(int(p), _COMMON, pack(common[at[p] : at[p + 1]], 6)) for p in np.flatnonzero(np.diff(at))]
            grams, tags = grams[~often], tags[~often]
        at = np.searchsorted(_cut(grams, parts), np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(at)):
            g, t = grams[at[p] : at[p + 1]], tags[at[p] : at[p + 1]]
            body = pack(np.diff(g, prepend=g[:1]))
            out.append((int(p), _OWN, int(len(body)).to_bytes(4, "little") + int(g[0]).to_bytes(8, "little") + body + pack(t, 8)))
        ids, kinds, blobs = zip(*out, strict=True)
        return pa.record_batch({"part": pa.array(ids, pa.int32()), "kind": pa.array(kinds, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return map_batches(with_columns(docs, ["text"]), one, "part int, kind int, blob binary", most=4 << 20)


def _shared(postings: DataFrame, regroups: int) -> DataFrame:
    """Within a fragment, the n-grams of two sets or more, dealt by the tag of the set."""

    def fragment(table: pa.Table) -> pa.Table:
        grams, tags, common, by_tag, passing = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind == _COMMON:
                common.append(unpack(blob))
            elif kind == _PASSING:
                m = (len(blob) - 2) // 14
                by_tag.append(unpack(blob[: 1 + 8 * m]))
                passing.append(unpack(blob[1 + 8 * m :]))
            else:
                size = int.from_bytes(blob[:4], "little")
                grams.append(np.cumsum(unpack(blob[12 : 12 + size])) + np.uint64(int.from_bytes(blob[4:12], "little")))
                tags.append(unpack(blob[12 + size :]))
        gram, tag, common = np.concatenate(grams), np.concatenate(tags), np.unique(np.concatenate(common))
        order = np.argsort(gram, kind="stable")
        gram, tag = gram[order], tag[order]
        known = np.zeros(len(gram), bool)
        if len(common) and len(gram):
            known = common[np.minimum(np.searchsorted(common, gram), len(common) - 1)] == gram
        twice = known.copy()
        if len(gram):
            same = gram[1:] == gram[:-1]
            twice[1:] |= same
            twice[:-1] |= same
        gram, tag, known = gram[twice], tag[twice], known[twice]
        order = np.lexsort((tag, gram))
        gram, tag, known = gram[order], tag[order], known[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (tag[1:] != tag[:-1])
        gram, tag, known = gram[fresh], tag[fresh], known[fresh]
        begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, int)
        count = np.diff(np.r_[begins, len(gram)])
        each = np.repeat(count, count)
        kept = (each > 1) | known
        gram, tag, each, known = gram[kept], tag[kept], each[kept], known[kept]
        rank = np.where(known, COMMON_CLASS, np.floor(np.log2(np.maximum(each, 1)))).astype(np.uint64)
        gram, tag = np.concatenate([gram, *passing]), np.concatenate([tag, *by_tag])
        rank = np.r_[rank, np.full(len(gram) - len(rank), COMMON_CLASS, np.uint64)]
        group = _cut(tag, regroups, 64)
        order = np.argsort(group, kind="stable")
        gram, tag, rank, group = gram[order], tag[order], rank[order], group[order]
        ids, blobs = [], []
        at = np.searchsorted(group, np.arange(regroups + 1, dtype=np.uint64))
        for g in np.flatnonzero(np.diff(at)):
            cut = slice(at[g], at[g + 1])
            body = pack(tag[cut], 8) + pack(gram[cut], 6) + pack(rank[cut], 1)
            ids.append(int(g))
            blobs.append(body)
        give_back()
        return pa.table({"part": pa.array(ids, pa.int32()), "head": pa.array([False] * len(ids)), "blob": pa.array(blobs, pa.binary())})

    return postings.groupBy("part").applyInArrow(fragment, "part int, head boolean, blob binary")


def _heads(sets: DataFrame, regroups: int) -> DataFrame:
    """(part, head, blob): the key and size of each distinct set, dealt as _shared deals."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = batch.column(0).to_pylist()
        if not keys:
            return None
        group = _cut(_tags(keys), regroups, 64)
        sizes = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype="<u8")
        ids, blobs = [], []
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            ids.append(int(g))
            blobs.append(pack(sizes[rows], 6) + b"".join(keys[r] for r in rows))
        return pa.record_batch({"part": pa.array(ids, pa.int32()), "head": pa.array([True] * len(ids)), "blob": pa.array(blobs, pa.binary())})

    return map_batches(sets.select("key", "n_shingles"), one, "part int, head boolean, blob binary")


def _survivors(rows: DataFrame, share: int) -> DataFrame:
    """Sets of which at least share percent of the n-grams are shared: their shared n-grams, and those of the prefix in order."""

    def regroup(table: pa.Table) -> pa.Table:
        keys, sizes, parts = [], [], []
        for head, blob in zip(table.column("head").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if head:
                n = (len(blob) - 1) // 22
                sizes.append(unpack(blob[: 1 + 6 * n]))
                body = blob[1 + 6 * n :]
                keys += [body[16 * i : 16 * i + 16] for i in range(n)]
            else:
                n = (len(blob) - 3) // 15
                parts.append((unpack(blob[: 1 + 8 * n]), unpack(blob[1 + 8 * n : 2 + 14 * n]), unpack(blob[2 + 14 * n :])))
        out = {"key": [], "n": [], "grams": [], "prefix": []}
        if keys and parts:
            tag, gram, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((gram, rank, tag))
            tag, gram = tag[order], gram[order]
            # the same set from two batches passes its common n-grams on twice
            fresh = np.r_[True, (tag[1:] != tag[:-1]) | (gram[1:] != gram[:-1])]
            tag, gram = tag[fresh], gram[fresh]
            mine, size = _tags(keys), np.concatenate(sizes).astype(np.int64)
            if len(np.unique(mine)) < len(mine):
                raise RuntimeError("two sets share 64 bits of their keys")
            low, high = np.searchsorted(tag, mine, "left"), np.searchsorted(tag, mine, "right")
            for i in np.flatnonzero((high - low) * 100 >= share * size):
                own, n = gram[low[i] : high[i]].astype(np.int64), int(size[i])
                alone = n - len(own)
                reach = n - -(-share * n // 100) + 1
                out["key"].append(keys[i])
                out["n"].append(n)
                out["grams"].append(np.sort(own))
                out["prefix"].append(own[: max(0, reach - alone)])
        give_back()
        longs = pa.list_(pa.int64())
        return pa.table({"key": pa.array(out["key"], pa.binary()), "n": pa.array(out["n"], pa.int64()), "grams": pa.array(out["grams"], longs), "prefix": pa.array(out["prefix"], longs)})

    return rows.groupBy("part").applyInArrow(regroup, "key binary, n long, grams array<bigint>, prefix array<bigint>")


def _linked(pairs: DataFrame, segments: DataFrame, share: int) -> DataFrame:
    """Those pairs (a, b) that reach the threshold: overlaps counted by fragment, summed by pair."""
    left = segments.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("segment_a"))
    right = segments.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("segment_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("segment_a", "segment_b")).cast("long").alias("partial")
    )
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("partial").alias("both"))
    return total.where(F.col("both") * 100 >= share * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _segments(survivors: DataFrame, fragments: int) -> DataFrame:
    width = (1 << _BITS) // fragments
    return survivors.select(
        "key",
        "n",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(fragments - 1)), lambda f: F.struct(f.alias("fragment"), F.filter("grams", lambda g: F.least(F.floor(g / width), F.lit(fragments - 1)) == f).alias("segment")))).alias("s"),
    ).select("key", "n", "s.fragment", "s.segment")


def _reach(share: int):
    """The bounds on sizes and positions that a linked pair keeps; position counts the n-grams that come before."""
    least = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return (
        (F.col("n_a") * 100 >= share * F.col("n_b"))
        & (F.col("n_b") * 100 >= share * F.col("n_a"))
        & (least * (100 + share) >= share * (F.col("n_a") + F.col("n_b")))
    )


def near_duplicate_links(docs: DataFrame, members: DataFrame, n: int, share: int) -> DataFrame:
    """(a, b): links between the keys of distinct sets that together give all components of the exact join."""
    sets = members.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("n_shingles").alias("n_shingles"))
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(1, math.ceil(total / POSTINGS_PER_FRAGMENT))
    regroups = max(1, parts // 4)
    rows = _shared(_postings(docs, n, parts), regroups).unionByName(_heads(sets, regroups))
    survivors = stage(_survivors(rows, share), "ngram-survivors")
    segments = stage(_segments(survivors, OVERLAP_FRAGMENTS), "ngram-segments")
    prefix = stage(
        survivors.select("key", "n", (F.col("n") - F.size("grams")).alias("alone"), F.posexplode("prefix").alias("place", "gram")).select(
            "key", "n", "alone", "gram", (F.col("alone") + F.col("place")).alias("at"), F.floor(F.log(F.col("n")) / math.log(100 / share)).cast("int").alias("band")
        ),
        "ngram-prefix",
    )
    # Rounds: each set meets a leader among the sets with an n-gram in common (later rounds: a leader for each n-gram), of another group and about its own
    # size; groups of many copies join up in pairs as many as their rows.  Then every candidate pair still apart.
    links = prefix.sparkSession.createDataFrame([], "a binary, b binary")
    roots = prefix.sparkSession.createDataFrame([], "node binary, root binary")
    postings = prefix.count()
    for turn in range(ROUNDS):
        placed = prefix.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        mixed = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("gram")
        apart = stage(placed.join(mixed, "gram"), "ngram-apart")
        if turn and _pairs_apart(apart) <= PAIRS_PER_POSTING * postings:
            break
        # the set with the fewest n-grams of its own is likeliest near the others; every other round another, by chance
        order = F.struct(*([] if turn % 2 else ["alone"]), F.xxhash64("key", *(["gram"] if turn else []), F.lit(turn)), "key", "n", "at", "root")
        leaders = apart.groupBy("gram", "band").agg(F.min(order).alias("leader"))
        near = apart.join(leaders, ["gram", "band"]).where(F.col("leader.root") != F.col("root")).select(
            F.col("leader.key").alias("a"), F.col("leader.n").alias("n_a"), F.col("leader.at").alias("at_a"), F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")
        )
        found = stage(_linked(near.where(_reach(share)).select("a", "b").distinct(), segments, share), "ngram-links")
        if not found.limit(1).count():
            break
        links = links.unionByName(found)
        roots = components(links, "ngram-roots")
    one = apart.select("gram", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("root").alias("root_a"))
    two = apart.select("gram", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("root").alias("root_b"))
    rest = one.join(two, (one["gram"] == two["gram"]) & (F.col("root_a") < F.col("root_b")) & _reach(share)).select("a", "b").distinct()
    return links.unionByName(_linked(rest, segments, share))


def _pairs_apart(apart: DataFrame) -> int:
    """An upper bound of the pairs of sets in different groups that share an n-gram, counted for each n-gram."""
    sizes = apart.groupBy("gram", "root").count().groupBy("gram").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    return sizes.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0


def ngram_jaccard_components(docs: DataFrame, n: int = 5, share: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text, ...).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a row's set holds its
    distinct n-word shingles, all words as one where there are fewer.  Two rows
    link when 100 * |both| >= share * |either|; component_id is the smallest
    doc_id reachable.  Null, empty or blank text: an empty set, linked with
    nothing, its own doc_id.  Rows with equal sets are one node, so repeated
    rows, repeated ids and ties change nothing; a null doc_id takes the smallest
    id it reaches, or null.  No rows in: none out.  Other columns are ignored.
    N-grams are compared by 64-bit hash, 48 bits of it in the counting of
    overlaps; no prefix, cap or sample is applied.
    """
    members, found = _grouped(with_columns(docs, ["doc_id", "text"]), n, share)
    low = found.groupBy("root").agg(F.min("least").alias("component"))
    found = found.join(low, "root").select("key", "component")
    return members.join(found, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, n: int, share: int) -> tuple[DataFrame, DataFrame]:
    """set_members of docs, and (key, least doc_id, root) for each distinct set."""
    members = stage(set_members(docs, n), "ngram-members")
    links = stage(near_duplicate_links(docs, members, n, share), "ngram-all-links")
    groups = members.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"))
    nodes = components(links, "ngram-all")
    found = groups.join(nodes.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return members, stage(found, "ngram-groups")


def drop_near_duplicates(docs: DataFrame, n: int = 5, share: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, of which each group of ngram_jaccard_components keeps one.

    The one that stays has the smallest doc_id of the group (null last); of
    several rows with that id, the one of least set key, any of equal ones.  Rows
    with an empty set all stay.  Ids that are not null and not repeated, which
    is to say nearly all, are dropped by an anti join, broadcast only if counted
    few, so texts needn't be shuffled.
    """
    members, found = _grouped(with_columns(docs, ["doc_id", "text"]), n, share)
    sets = members.where(F.col("key").isNotNull()).join(found.select("key", "root"), "key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = sets.groupBy("root").agg(F.min(order).alias("one")).select("one.doc_id", "one.key")
    repeated = stage(members.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "ngram-repeated")
    goes = stage(sets.join(kept, ["doc_id", "key"], "left_anti").where(F.col("doc_id").isNotNull()).select("doc_id").unionByName(repeated).distinct(), "ngram-dropped")
    out = docs.where(F.col("doc_id").isNotNull()).join(small(goes), "doc_id", "left_anti").select(docs.columns)
    if not repeated.limit(1).count() and not members.where(F.col("doc_id").isNull()).limit(1).count():
        return out
    odd = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(small(repeated), "doc_id", "left_semi").select(docs.columns))
    place = docs.columns.index("text")

    def with_key(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = _keys(list(shingle_sets(batch.column(place), n)))
        return batch.append_column("__set_key", pa.array(keys, pa.binary()))

    odd = map_batches(odd, with_key, T.StructType([*docs.schema.fields, T.StructField("__set_key", T.BinaryType())]))
    chosen = kept.select(F.col("doc_id").alias("__kept_id"), F.col("key").alias("__kept_key"))
    blank = odd.where(F.col("__set_key").isNull()).select(docs.columns)
    one = odd.join(chosen, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__set_key") == F.col("__kept_key")), "left_semi")
    return out.unionByName(blank).unionByName(one.dropDuplicates(["doc_id", "__set_key"]).select(docs.columns))
