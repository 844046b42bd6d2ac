"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 80 % of their union are linked.

The join is exact. Documents with equal sets are one class; classes are compared, not their copies.

1. *Inverted lists.* Shingles are put in one order for the whole corpus: those that occur in many documents of a piece of
   the corpus last. Of each set only the first ``n - ceil(0.8 n) + l`` are listed. If two sets reach the overlap T that
   the similarity asks for, they share a number of these that follows from their sizes.
2. *Candidates.* A list's class with the lowest hash is its hub. Each class is first compared with the lowest
   hub of its lists; in a group of near copies that links nearly all of them, whatever the group's size.
   What is left are lists whose members are not yet known to be connected. There a growing share of the
   classes is compared with the members of their lists in other components that share enough listed shingles,
   until all were. No pair within a component is listed, and none whose sketches show that it cannot be linked: a
   sketch has a bit for each slot of shingles, set if the slot holds an odd number of the set, so two sets differ by
   as many shingles as their sketches by bits, or more. ``class_links`` and ``link_counts`` search every
   pair of classes that share enough listed shingles instead, those within a component too.
3. *T-occurrence search.* A hub (query) and its candidates meet in blocks. The candidates are indexed by the
   hub's shingles; DivideSkip sets the longest lists aside, heap-merges the short ones, keeps what occurs
   there T minus their number times, probes the long lists by binary search and retains what reaches T.
4. *Components* of all links, in rounds on the executors.

Shingles are compared by 64-bit hashes, classes by a 64-bit hash of the set and its size.

Edge cases: texts without words (null, empty) are linked with nothing; fewer than five words are one shingle; rows
with the same doc_id and text are copies; component_id is the smallest doc_id that is not null (null if there is none);
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centsible.llm.arrays import (
    LOWER,
    NOT_SPACE,
    U64,
    column,
    constants,
    mix,
    per_row_unique,
    pieces,
    quiet,
    ranges,
    shingles,
    signed,
    span_hashes,
    spans,
    text_column,
    unsigned,
)
from centsible.llm.bloom import BloomFilter
from centsible.llm.frames import bucketed, map_batches, pieces_for, text_id, written, written_counted
from centsible.llm.graph import components, forest_roots

#: Shingles are counted in pieces of the corpus of so many.
COUNTED_TOGETHER = 4 << 20
#: At most so many frequent shingles are told apart in the order, in so many slots.
FREQUENT = 1 << 20
SLOT_BITS = 23
#: So many classes are compared with all members of their open lists first, and GROWTH times as many each turn.
FIRST_TURN, GROWTH = 200, 64
#: Pairs that a task holds at once.
AT_ONCE = 1 << 20
#: Candidates of one hub that are searched together.
BLOCK = 200
#: A sketch is so many words of 64 bits: sets of up to about a thousand shingles are told apart by it.
SKETCH = tuple(f"sketch{n}" for n in range(8))
#: Sets that are sketched at once.
SKETCHED = 2048
SET, TURN = constants(2, 701)


def sets_of(texts: pa.Array):
    """Per piece: first row, end row, all rows' distinct shingle hashes in ascending order, row begins, set hashes."""
    for first_row, end_row, data, begin in pieces(texts):
        starts, ends, first = spans(NOT_SPACE[data], begin)
        flat, opens = shingles(span_hashes(data, starts, ends, LOWER), first)
        flat, opens = per_row_unique(flat, opens)
        total = np.concatenate(([U64(0)], np.cumsum(mix(flat + SET))))
        n = np.diff(opens)
        yield first_row, end_row, flat, opens, mix(total[opens[1:]] - total[opens[:-1]] + n.astype(U64))


def sketches(flat: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Of each set one row of words: the parity of the number of shingles in each of the slots."""
    bits, out = 64 * len(SKETCH), [np.zeros((0, len(SKETCH)), np.int64)]
    for a in range(0, len(opens) - 1, SKETCHED):
        begin = opens[a : a + SKETCHED + 1]
        owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        slot = (flat[begin[0] : begin[-1]] % U64(bits)).astype(np.int64)
        odd = np.bincount(owner * bits + slot, minlength=(len(begin) - 1) * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64))
    return np.concatenate(out)


def may_link(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the sketches (a column each) of sets of n and m members leave room for the overlap of linked ones."""
    apart = np.bitwise_count(unsigned(left) ^ unsigned(right)).sum(axis=0, dtype=np.int64)
    return (n + m - apart) // 2 >= -(-80 * (n + m) // 180)


def listed(n):
    """How many shingles of a set of n are listed: enough for a linked pair to share one, and some more,
    which makes far fewer chance pairs."""
    return np.minimum(n, n - (4 * n + 4) // 5 + 1 + n // 40)


def shared_prefixes(n, m):
    """l and how far the listed shingles of sets of n and m members reach that decide whether these are linked.

    If both share T shingles, the first n - T + l of the one and the first m - T + l of the other
    have l in common. That is a part of what is listed, which has to do for partners of any size, and leaves
    out the most frequent shingles of it.
    """
    overlap = -(-80 * (n + m) // 180)
    shared = 1 + np.minimum(n, m) // 40
    return shared, n - overlap + shared, m - overlap + shared


# ---- sets, classes and the order of shingles -------------------------------------------------


def _profile(docs: DataFrame) -> DataFrame:
    """Per document doc_id, tid, n, cls (0 shingles: null) and sketch; and rows of frequent shingles with their count."""

    def run(batches):
        held, size, seen = [], 0, set()

        def frequent():
            values, count = np.unique(np.concatenate(held), return_counts=True)
            values, count = values[count > 1], count[count > 1]
            return _rows(len(values), {"shingle": signed(values), "count": count})

        for batch in batches:
            at = batch.schema.get_field_index
            with quiet():
                for first_row, end_row, flat, opens, cls in sets_of(text_column(batch)):
                    n = np.diff(opens)
                    part = batch.slice(first_row, end_row - first_row)
                    yield _rows(
                        len(n),
                        {
                            "doc_id": part.column(at("doc_id")),
                            "tid": part.column(at("tid")),
                            "n": n,
                            "cls": pa.array(signed(cls), mask=n == 0),
                            **dict(zip(SKETCH, sketches(flat, opens).T)),
                        },
                    )
                    # copies within the task count once
                    fresh = [i for i, c in enumerate(cls.tolist()) if c not in seen and not seen.add(c)]
                    new = np.zeros(len(n), bool)
                    new[fresh] = True
                    held.append(flat[np.repeat(new, n)])
                    size += len(held[-1])
                    if size > COUNTED_TOGETHER:
                        yield frequent()
                        held, size, seen = [], 0, set()
        if held:
            yield frequent()

    kinds = dict.fromkeys(("doc_id", "tid", "n", "cls", *SKETCH, "shingle", "count"), pa.int64())

    def _rows(rows, columns):
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], k) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(rows, k)) for c, k in kinds.items()],
            list(kinds),
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid"), "text")
    return map_batches(source, run, ", ".join(f"{c} long" for c in kinds))


def _levels(profile: DataFrame) -> np.ndarray:
    """The level (2-logarithm of the count) of each slot of shingles, 0 for all that are not frequent."""
    counts = profile.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("count")).where("count >= 4")
    counts = written(counts.select("shingle", F.floor(F.log2("count")).cast("int").alias("level")), "frequent")
    sizes = {r.level: r["count"] for r in counts.groupBy("level").count().collect()}  # at most 64 rows
    least, total = 64, 0
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > FREQUENT:
            break
        least = level
    slots = np.zeros(1 << SLOT_BITS, np.uint8)
    frequent = counts.where(F.col("level") >= least).toArrow()  # at most FREQUENT rows, in one job
    place = unsigned(frequent["shingle"].to_numpy()) >> U64(64 - SLOT_BITS)
    np.maximum.at(slots, place, frequent["level"].to_numpy().astype(np.uint8))
    return slots


# ---- inverted lists --------------------------------------------------------------------------


def _postings(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """key, cls, n, place: the first shingles of each set, by (level, hash); copies within a task give them once."""
    held = docs.sparkSession.sparkContext.broadcast(levels)  # 2**SLOT_BITS bytes

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            with quiet():
                for _, _, flat, opens, cls in sets_of(text_column(batch)):
                    keys = held.value[flat >> U64(64 - SLOT_BITS)].astype(U64) << U64(58) | flat >> U64(6)
                    n = np.diff(opens)
                    take = listed(n)
                    found, owner = [np.zeros(0, U64)], []
                    for i, (c, a, b, p) in enumerate(zip(cls.tolist(), opens.tolist(), opens[1:].tolist(), take.tolist())):
                        if b > a and c not in seen:
                            seen.add(c)
                            found.append(np.sort(keys[a:b] if p >= b - a else np.partition(keys[a:b], p - 1)[:p]))
                            owner.append(i)
                    owner = np.array(owner, np.int64)
                    place = ranges(np.zeros(len(owner), np.int64), take[owner])
                    owner = np.repeat(owner, take[owner])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(np.concatenate(found))),
                            pa.array(signed(cls[owner])),
                            pa.array(n[owner].astype(np.int32)),
                            pa.array(place.astype(np.int32)),
                        ],
                        ["key", "cls", "n", "place"],
                    )

    return map_batches(docs.select("text"), run, "key long, cls long, n int, place int")


def _lists(postings: DataFrame) -> DataFrame:
    """key, cls, n, place, hub, hub_n of all lists of two classes or more; the hub is a list's first class."""

    def run(batches):
        # the last row seen: whether it was given out (a row of its list stood before it), and its list's hub
        kinds = {"key": np.int64, "cls": np.int64, "n": np.int32, "place": np.int32}
        key, cls, n, place = (np.zeros(0, t) for t in kinds.values())
        given, hub = False, (0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            carried = len(key) == 1
            key, cls, n, place = (np.concatenate((x, column(batch, c))) for x, c in zip((key, cls, n, place), kinds))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, n, place = key[fresh], cls[fresh], n[fresh], place[fresh]
            opens = np.ones(len(key), bool)
            opens[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            hub_cls, hub_n = cls[first], n[first]
            before, after = ~opens, np.zeros(len(key), bool)
            after[:-1] = ~opens[1:]
            if carried:
                hub_cls[first == 0], hub_n[first == 0] = hub
                before[0] = given
            out = before | after
            if given:
                out[0] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[out]) for x in (key, cls, n, place, hub_cls, hub_n)], [*kinds, "hub", "hub_n"]
            )
            given, hub = bool(before[-1]), (hub_cls[-1], hub_n[-1])
            key, cls, n, place = key[-1:], cls[-1:], n[-1:], place[-1:]

    ordered = postings.repartition("key").sortWithinPartitions("key", "cls")
    return map_batches(ordered, run, "key long, cls long, n int, place int, hub long, hub_n int")


# ---- T-occurrence search ---------------------------------------------------------------------


def linked(common, n, m):
    """Whether sets of n and m members with so many in common are at least 80 % alike."""
    return 100 * common >= 80 * (n + m - common)


def overlap_needed(n: int, m: int) -> int:
    """The least overlap of linked sets of n and m members."""
    return -(-80 * (n + m) // 180)


def divide_skip(lists: list[list[int]], needed: list[int]) -> list[int]:
    """Ids that occur in ``needed[id]`` of the sorted lists at least.

    Of the lists, the longest are set aside, as many as keep merging and probing about equal. The short
    ones are merged by a heap; an id that is in fewer than T minus the number of long lists cannot reach T.
    """
    least = min(needed)
    lists = sorted(lists, key=len)
    if len(lists) < least:
        return []
    aside = int(least / (1 + 0.1 * np.log2(len(lists[-1]) + 1)))
    aside = max(0, min(aside, least - 1, len(lists)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = []
    for member, run in groupby(heapq.merge(*short)):
        count = sum(1 for _ in run)
        if count + aside < needed[member]:
            continue
        for probed, postings in enumerate(long):
            place = bisect_left(postings, member)
            count += place < len(postings) and postings[place] == member
            if count + len(long) - probed - 1 < needed[member]:
                break
        if count >= needed[member]:
            found.append(member)
    return found


def search_block(query: np.ndarray, flat: np.ndarray, opens: np.ndarray) -> list[int]:
    """Rows of the block (their sorted sets in ``flat``) that are linked with the query's sorted set."""
    n = np.diff(opens)
    place = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[place] == flat
    owner = np.repeat(np.arange(len(n)), n)[hit]
    shingle = place[hit]
    order = np.argsort(shingle, kind="stable")  # keeps the rows ascending within a list
    cuts = np.flatnonzero(np.diff(shingle[order])) + 1
    lists = [part.tolist() for part in np.split(owner[order], cuts)] if len(order) else []
    if not lists:
        return []
    return divide_skip(lists, [overlap_needed(len(query), m) for m in n.tolist()])


def _texts(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """rid, text of the wanted documents, bucketed by rid, and some others.

    A Bloom filter of bounded size keeps nearly all other documents from being shuffled; what passes it
    by chance is never asked for.
    """
    held = docs.sparkSession.sparkContext.broadcast(BloomFilter.build(wanted.select("rid")).blocks)

    def run(batches):
        bloom = BloomFilter(held.value)
        for batch in batches:
            hit = pa.array(bloom.may_hold(np.ascontiguousarray(column(batch, "rid"))))
            yield batch.filter(hit)

    source = docs.select(_rid(F.col("doc_id").cast("long"), text_id()).alias("rid"), "text")
    return bucketed(map_batches(source, run, "rid long, text string"), "texts", "rid", pieces_for(source))


def _rid(doc_id: Column, tid: Column) -> Column:
    """64 bits of a document's id and text."""
    return F.xxhash64(doc_id, tid)


def _search(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of the linked ones among candidate pairs (hub, cls), a table. ``classes``: cls, rid; ``texts``: rid, text
    of all classes in them, bucketed, so that only ids are shuffled to them and only the texts that are asked for go on.

    A hub and at most about BLOCK of its candidates make a block; a hub with more has more blocks. Its text is
    looked up once and dealt to its blocks afterwards.
    """
    per_hub = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # a row per BLOCK pairs at most, and a table of known size: mostly broadcast, so that no hub's pairs meet in a task
    busy = written(per_hub.where("blocks > 1"), "busy-hubs").withColumnsRenamed({"hub": "busy", "blocks": "busy_blocks"})
    blocks = F.coalesce("busy_blocks", F.lit(1))
    dealt = pairs.join(busy, F.col("hub") == F.col("busy"), "left").withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    members = dealt.select("hub", "cls", F.lit(1).alias("member"), F.col("block").alias("low"), F.col("block").alias("high"))
    hubs = per_hub.select("hub", F.col("hub").alias("cls"), F.lit(0).alias("member"), F.lit(0).alias("low"), (F.col("blocks") - 1).alias("high"))
    asked = hubs.union(members).join(classes.select("cls", "rid"), "cls").join(texts, "rid")
    rows = asked.select("hub", F.explode(F.sequence("low", "high")).alias("block"), "member", "cls", "text")
    rows = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "member")

    def run(batches):
        block, query = None, None
        for batch in batches:
            at = batch.schema.get_field_index
            hub, part, member, cls = (column(batch, c) for c in ("hub", "block", "member", "cls"))
            found: list[tuple[int, int]] = []
            with quiet():
                flat, opens = _joined_sets(batch.column(at("text")))
                heads = np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (part[1:] != part[:-1])))
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(hub)]):
                    while a < b and member[a] == 0:  # once, or again for repeated rows
                        block, query = (hub[a], part[a]), flat[opens[a] : opens[a + 1]].copy()
                        a += 1
                    if a < b:
                        assert block == (hub[a], part[a])
                        rows = search_block(query, flat[opens[a] : opens[b]], opens[a : b + 1] - opens[a])
                        found += [(hub[a], cls[a + r]) for r in rows]
            u, v = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return map_batches(rows, run, "u long, v long")


def _joined_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, count = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, _, part, opens, _ in sets_of(texts):
        flat.append(part)
        count.append(np.diff(opens))
    return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(count))))


# ---- candidates ------------------------------------------------------------------------------


def _alike_sizes(n, m):
    return 80 * F.greatest(n, m) <= 100 * F.least(n, m)


def _first_pairs(lists: DataFrame) -> DataFrame:
    """hub, cls: each class with the lowest hub of its lists."""
    near = lists.where((F.col("cls") != F.col("hub")) & _alike_sizes(F.col("n"), F.col("hub_n")))
    return near.groupBy("cls").agg(F.min("hub").alias("hub"))


def _open_lists(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, cls, n, place, root of the lists with classes of two components or more; ``roots`` (node, root) says
    which of the components that ``rows`` name have grown together."""
    if roots is not None:
        known = rows.join(roots.withColumnsRenamed({"node": "was", "root": "now"}), F.col("root") == F.col("was"), "left")
        rows = known.select("key", "cls", "n", "place", F.coalesce("now", "root").alias("root"))
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rows.join(apart.select("key"), "key", "left_semi")


def _has_turn(turn: int, share: float) -> Column:
    """Whether it is a class's turn: a given share of all classes, drawn anew each time."""
    bound = min(int(share * (1 << 53)), 1 << 53)
    return F.shiftrightunsigned(F.xxhash64("cls", F.lit(turn)), 11) < bound


def _further_pairs(lists: DataFrame, classes: DataFrame, turn: int, share: float) -> DataFrame:
    """hub, cls and their components: the classes whose turn it is with the members of their open lists in other
    components, where both share as many lists as linked sets must and their sketches (of ``classes``) allow it. So few
    pairs are listed that are not linked, however many classes a list has."""
    ordered = lists.withColumn("late", F.when(_has_turn(turn, share), 0).otherwise(1)).join(classes.select("cls", *SKETCH), "cls")
    ordered = ordered.repartition("key").sortWithinPartitions("key", "late", "cls")
    names = ["key", "late", "cls", "n", "place", "root", *SKETCH]

    def run(batches):
        held = np.zeros((len(names), 0), np.int64)  # hubs of the list that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            old = held.shape[1]
            rows = np.concatenate((held, np.stack([column(batch, c).astype(np.int64) for c in names])), axis=1)
            key, late, cls, n, place, root = rows[:6]
            opens = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            # hubs stand first in a list: each row meets the hubs before it
            hubs = np.concatenate(([0], np.cumsum(late == 0)))
            meets = hubs[:-1] - hubs[first]
            meets[:old] = 0  # they met before
            total = np.concatenate(([0], np.cumsum(meets)))
            a = 0
            while a < len(key):
                b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1)
                left = np.repeat(np.arange(a, b), meets[a:b])
                right = ranges(first[a:b], meets[a:b])
                fits = root[left] != root[right]
                left, right = left[fits], right[fits]
                big, small = np.maximum(n[left], n[right]), np.minimum(n[left], n[right])
                shared, left_end, right_end = shared_prefixes(n[left], n[right])
                fits = (80 * big <= 100 * small) & (place[left] < left_end) & (place[right] < right_end)
                left, right, shared = left[fits], right[fits], shared[fits]
                fits = may_link(rows[6:, left], rows[6:, right], n[left], n[right])
                left, right, shared = left[fits], right[fits], shared[fits]
                swapped = cls[left] > cls[right]
                left, right = np.where(swapped, right, left), np.where(swapped, left, right)
                columns = [cls[left], cls[right], root[left], root[right], shared]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["hub", "cls", "hub_root", "cls_root", "need"]
                )
                a = b
            held = rows[:, (key == key[-1]) & (late == 0)]

    kinds = "hub long, cls long, hub_root long, cls_root long, need long"
    met = map_batches(ordered, run, kinds).groupBy("hub", "cls", "hub_root", "cls_root")
    enough = met.agg(F.count("*").alias("have"), F.max("need").alias("need")).where("have >= need")
    return enough.select("hub", "cls", "hub_root", "cls_root")


def _listed(docs: DataFrame, classes: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """cls, rid and sketch of the classes in lists; rid, text of their documents and the name of that table."""
    sketch = [F.col(f"first.{name}").alias(name) for name in SKETCH]
    classes = classes.select("cls", _rid(F.col("first.doc_id"), F.col("first.tid")).alias("rid"), *sketch)
    wanted = written(classes.join(lists.select("cls").distinct(), "cls"), "listed-classes")
    return wanted, *_texts(docs, wanted)


def _links(docs: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame | None:
    """node, root of all classes that are linked with another; None if there are none.

    The first links hang each class below one of lower hash: a forest. Links of later turns lie between components, so
    only the components they name are put together, and the classes are told their new one at the end.
    """
    wanted, texts, table_name = _listed(docs, classes, lists)
    pairs, (n_pairs,) = written_counted(_first_pairs(lists), "pairs", F.count("*"))
    grown: list[DataFrame] = []
    if n_pairs:
        links = _search(pairs, wanted, texts).select(F.col("v").alias("node"), F.col("u").alias("parent"))
        links, (n_links,) = written_counted(links, "links", F.count("*"))
        grown += [forest_roots(links)] if n_links else []
    turn, share, n_classes = 0, 0.0, wanted.count()
    rows = lists.select("key", "cls", "n", "place", F.col("cls").alias("root"))
    latest, open_lists = (grown[-1] if grown else None), None
    while share < 1:
        if open_lists is None:
            open_lists, (n_open,) = written_counted(_open_lists(rows, latest), "open-lists", F.count("*"))
            if not n_open:
                break
        share = FIRST_TURN * GROWTH**turn / max(n_classes, 1)
        pairs, (n_pairs,) = written_counted(_further_pairs(open_lists, wanted, turn, share), "pairs", F.count("*"))
        # classes that had their turn have met all members of their lists
        rows = open_lists = open_lists.where(~_has_turn(turn, share))
        turn += 1
        if not n_pairs:
            continue
        found = _search(pairs.select("hub", "cls"), wanted, texts)
        named = found.join(pairs, (found["u"] == pairs["hub"]) & (found["v"] == pairs["cls"]))
        between = named.select(F.col("hub_root").alias("u"), F.col("cls_root").alias("v")).distinct()
        links, (n_links,) = written_counted(between, "links", F.count("*"))
        if n_links:
            latest, open_lists = components(links), None
            grown.append(latest)
    docs.sparkSession.sql(f"DROP TABLE {table_name}")  # the catalog's entry; what was found is written
    if not grown:
        return None
    roots = wanted.select(F.col("cls").alias("node"), F.col("cls").alias("root"))
    for latest in grown:
        ends = latest.select(F.col("node").alias("was"), F.col("root").alias("now"))
        roots = roots.join(ends, roots["root"] == ends["was"], "left").select("node", F.coalesce("now", "root").alias("root"))
    return written(roots, "roots")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with n and cls; cls and ``first``, its first document and the sketch; the inverted lists."""
    profile = written(_profile(docs), "profile")
    rows = profile.where("shingle IS NULL").select("doc_id", "tid", "n", "cls")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid", *SKETCH)
    classes = profile.where("cls IS NOT NULL").groupBy("cls").agg(F.min(first).alias("first"))
    lists = written(_lists(_postings(docs, _levels(profile))), "lists")
    return rows, classes, lists


def shingle_components(docs: DataFrame) -> DataFrame:
    """doc_id, tid, n_shingles, component_id and ``cls`` (64-bit id of the set; null if empty) of every document."""
    return _rooted(docs).drop("root")


def _rooted(docs: DataFrame) -> DataFrame:
    """The same with ``root``, which tells components apart that share their smallest doc_id."""
    rows, classes, lists = _classes(docs)
    roots = _links(docs, classes, lists)
    if roots is None:
        least = classes.select("cls", F.col("cls").alias("root"), F.col("first.doc_id").alias("least"))
    else:
        grown = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        grown = grown.select("cls", F.coalesce("root", "cls").alias("root"), F.col("first.doc_id").alias("doc_id"))
        per_root = grown.groupBy("root").agg(F.min("doc_id").alias("least"))
        least = grown.join(per_root, "root").select("cls", "root", "least")
    joined = rows.join(least, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", "tid", F.col("n").alias("n_shingles"), component.alias("component_id"), "cls", "root")


def class_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, tid, n_shingles and cls of every document, and u < v of every two linked classes.

    Members of a class have equal sets; they are linked with each other and with all members of the classes
    theirs is linked with. There are as many links as linked pairs of different sets, so in a group of near copies
    they grow with the square of its size; ``shingle_components`` finds the components without them.
    """
    rows, classes, lists = _classes(docs)
    wanted, texts, table_name = _listed(docs, classes, lists)
    every = lists.select("key", "cls", "n", "place", F.col("cls").alias("root"))
    pairs = _further_pairs(_open_lists(every, None), wanted, 0, 1.0).select("hub", "cls")  # it is every class's turn
    links = written(_search(written(pairs, "pairs"), wanted, texts).distinct(), "links")
    docs.sparkSession.sql(f"DROP TABLE {table_name}")  # the catalog's entry; what was found is written
    return rows.withColumnRenamed("n", "n_shingles"), links


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tid, n_shingles, cls (null if empty) and n_links of every document: the number of other rows
    that it is linked with, those with an equal set included."""
    members, links = class_links(docs)
    sizes = members.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("size"))
    both = links.union(links.select("v", "u"))
    others = both.join(sizes, both["v"] == sizes["cls"]).groupBy("u").agg(F.sum("size").alias("others"))
    counted = sizes.join(others, sizes["cls"] == others["u"], "left")
    counted = counted.select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    joined = members.join(counted, "cls", "left")
    return joined.select("doc_id", "tid", "n_shingles", "cls", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """All columns of the rows of ``docs`` that stay if each component keeps one document: the one with the
    smallest doc_id and, among texts that share it, the smallest ``tid``. Rows that repeat that document stay too;
    rows without words or without a doc_id all stay. Other texts under a removed row's doc_id are not touched."""
    found = written(_rooted(docs).where("cls IS NOT NULL AND doc_id IS NOT NULL").select("root", "doc_id", "tid"), "rooted")
    kept = found.groupBy(F.col("root").alias("of")).agg(F.min(F.struct("doc_id", "tid")).alias("kept"))
    gone = found.join(kept, found["root"] == kept["of"]).where(F.struct("doc_id", "tid") != F.col("kept"))
    # a table of known size: Spark broadcasts it if it is small and shuffles the documents if not
    gone = written(gone.select(F.col("doc_id").alias("gone_id"), F.col("tid").alias("gone_tid")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & text_id().eqNullSafe(gone["gone_tid"])
    return docs.join(gone, same, "left_anti")
