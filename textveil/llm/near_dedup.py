"""Near-duplicate detection: ProbMinHash, banding, verification, connected groups.

1. Equal texts form a class, named by their digest; only classes go on.
2. Each class gets a ProbMinHash sketch of its word shingles weighted by how often they
   occur, and one key per band. As links are decided by sets (step 4), a class in which a
   shingle occurs twice gets the keys of a sketch without weights, too; without repeats both
   are the same. Classes that share a key are a bucket.
3. Every member of a bucket is compared with the bucket's pivot first. The pivot is the
   member whose keys are shared most: around an original with many edited copies that is
   the original, and it is the same one for most of their buckets.
4. A compared pair is verified on its whole texts: the Jaccard similarity of the shingle
   sets must reach the threshold.
5. Groups are the connected components of the links, found by rounds of joins.
6. Members that are not in their pivot's group get a pivot of their own, bucket by bucket,
   and so on until a round brings no new link.
7. Members that are then in different groups of a bucket are compared by prefix filtering.
   Shingles have one order for all, rare ones first; two texts at the threshold share one of
   the first few shingles of both, as many as they may differ in. What a template gives many
   texts in common is in none of these, unless it alone brings them to the threshold. Pairs
   that share one, in different groups, and whose marks do not show that they are below the
   threshold are verified. The marks say on which of 2048 places a text's shingles fall; the bound they give is exact.

Bands: with 32 keys of 5 registers, two texts at similarity 0.8 share none with a chance of
3 in a million, however often shingles are repeated. Texts that share one are compared, in
one group anyway, or below the threshold by one of the two exact bounds.

Hot groups: copies are counted before the shuffle and never expanded; every join but that of
step 7 has one row per key on one side and reads written tables, so that adaptive execution
can split the other side. Step 7 joins the members on their rare shingles: what many texts
have in common, a template or a passage, is common and so comes last in the order. How rare a
shingle is, is read from counts on 2^18 places, which the driver holds; they only shape the
order, any order gives the same links. Nothing collects a bucket, a group or links.

Results that are defined: null text is empty; equal texts, empty ones included, are copies
of one another; a text with fewer words than a shingle is one shingle; rows with equal id
and text share one result; rows of one id with different texts are apart; a null id comes
after all others; extra columns are not read by ``groups_of`` and kept by ``keep_one``; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.hashes import mix
from textveil.llm.prob_minhash import SHINGLE, U, band_keys, shingles, sketch
from textveil.llm.shared import discard, flat, numbered, slices, stored

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: Texts that are sketched at a time.
SKETCHED = 1000
#: Places for the shingles of a text, by which pairs that can't be similar are told.
MARKS = 2048
#: Places on which shingles are counted to order them by rarity.
PLACES = 1 << 18


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``node`` (digest of the text), ``row`` (of both) and ``text``."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), _text(text_col).alias("text")).select(
        "id", F.unhex(F.md5("text")).alias("node"), row_key(F.col("id"), F.col("text")).alias("row"), "text"
    )


def row_key(id_: Column, text: Column) -> Column:
    """A key without nulls of a row's id and text."""
    return F.concat(F.md5(text), F.coalesce(F.concat(F.lit(":"), id_.cast("string")), F.lit("")))


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A short text takes as many arrivals as a long one to fill its registers.
        for batch in (part.slice(row, SKETCHED) for part in slices(batches) for row in range(0, part.num_rows, SKETCHED)):
            name, text, count = shingles(*flat(batch.column("text")), size)
            n = batch.num_rows
            full = np.flatnonzero(np.bincount(text, minlength=n) > 0)
            weighted = sketch(name, text, count.astype(np.float64), n, bands * rows)
            keys, owner = [band_keys(weighted[full], rows).ravel()], [np.repeat(full, bands)]
            again = np.flatnonzero(np.bincount(text[count > 1], minlength=n) > 0)
            if len(again):
                mine = np.isin(text, again)
                place = np.searchsorted(again, text[mine])
                plain = sketch(name[mine], place, np.ones(len(place)), len(again), bands * rows)
                keys.append(band_keys(plain, rows).ravel())
                owner.append(np.repeat(again, bands))
            key, of = np.concatenate(keys), np.concatenate(owner)
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))[: len(key)]
            key, of = key[new], of[new]
            at = np.append(np.searchsorted(of, full), len(of)).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(full)), lists], names=["node", "keys"])

    return run


def _similar(size: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", "text_b"):
            sides = []
            for column in ("text_a", "text_b"):
                name, pair, _ = shingles(*flat(batch.column(column)), size)
                sides.append((mix(name + mix(pair.astype(U))), pair))
            (one, pair), (two, other) = sides
            n = batch.num_rows
            both = np.bincount(pair[np.isin(one, two)], minlength=n)
            union = np.bincount(pair, minlength=n) + np.bincount(other, minlength=n) - both
            take = pa.array(np.flatnonzero((both > 0) & (both >= threshold * union - 1e-9)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("a", "b")], names=["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_similar(size, threshold), "a binary, b binary")


def _marks(size: int):
    """How many shingles a text has, which of ``MARKS`` places they fall on, and how many
    fall on places that are taken."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            name, text, _ = shingles(*flat(batch.column("text")), size)
            taken = np.zeros((batch.num_rows, MARKS), bool)
            taken[text, (mix(name) % U(MARKS)).astype(np.int64)] = True
            n = np.bincount(text, minlength=batch.num_rows)
            words = np.packbits(taken, axis=1).view(np.int64)
            marks = pa.ListArray.from_arrays(
                np.arange(0, words.size + 1, words.shape[1], dtype=np.int32), pa.array(words.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(n), pa.array(n - taken.sum(axis=1)), marks],
                names=["node", "n", "hidden", "marks"],
            )

    return run


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, label`` for every node of a link: the least node of its component. ``known``
    has the labels of an earlier run on some of the links.

    Each round takes the least label among a node, its neighbours and the nodes labelled by
    it; from the third round on it goes on to the label of that label. It ends when nothing
    changes: after two or three rounds around pivots, after about as many as the logarithm
    of the longest path otherwise.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    both = stored(both.union(both.select("near", "node")).distinct(), "edges")
    first = both.groupBy("node").agg(F.min("near").alias("label")).select("node", F.least("node", "label").alias("label"))
    if known is not None:
        first = first.union(known).groupBy("node").agg(F.min("label").alias("label"))
    labels, rounds = stored(first, "labels"), 0
    while True:
        # A node passes its label to its neighbours and to the node it is labelled by.
        offers = both.join(labels, "node").select(F.col("near").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
        offers = offers.union(labels.selectExpr("label", "label", "cast(NULL AS binary)"))
        offers = offers.union(labels.selectExpr("node", "label", "label"))
        after = offers.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        after = stored(after, "labels")
        if rounds >= 2:
            jump = after.select(F.col("node").alias("label"), F.col("label").alias("further"))
            after = stored(
                after.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), "old"), "labels"
            )
        rounds += 1
        done = after.where("old IS NULL OR label != old").isEmpty()
        discard(labels)
        labels = after.select("node", "label")
        if done:
            discard(both)
            return labels


def _buckets(rows: DataFrame, size: int, bands: int, height: int) -> DataFrame:
    """``key, node, shares`` of all buckets with two classes or more; ``shares`` ranks a
    class by how many others have its keys."""
    sketches = rows.select("node", "text").mapInArrow(_sketch(size, bands, height), "node binary, keys array<long>")
    sketches = stored(sketches.dropDuplicates(["node"]), "sketches")
    members = sketches.select(F.explode("keys").alias("key"), "node")
    counts = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    buckets = stored(members.join(counts, "key"), "buckets")
    rank = stored(buckets.groupBy("node").agg(F.sum("n").alias("shares")), "ranks")
    ranked = stored(buckets.join(rank, "node").select("key", "node", "shares"), "ranked")
    discard(sketches, counts, buckets, rank)
    return ranked


def _with_pivots(members: DataFrame) -> DataFrame:
    """``key, node, shares, pivot`` of all members but the pivots themselves."""
    most = members.groupBy("key").agg(F.max(F.struct("shares", F.xxhash64("node").alias("tie"), "node")).alias("top"))
    most = stored(most.select("key", F.col("top.node").alias("pivot")), "pivots")
    members = members.select("key", "node", "shares")
    return stored(members.join(most, "key").where("node != pivot"), "members")


def _outside(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members that are not in their pivot's group."""
    one = labels.withColumnRenamed("label", "own")
    two = labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
    both = members.join(one, "node", "left").join(two, "pivot", "left")
    apart = F.coalesce("own", "node") != F.coalesce("pivot_label", "pivot")
    return both.where(apart).select("key", "node", "shares", "pivot")


def _rarity(size: int):
    """How many of the texts have a shingle on each place: a row a place and task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in slices(batches):
            name, _, _ = shingles(*flat(batch.column("text")), size)
            total += np.bincount((name % U(PLACES)).astype(np.int64), minlength=PLACES)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    return run


def _prefixes(size: int, threshold: float, counts: np.ndarray):
    """The first shingles of each text in the order of their rarity, with their places: one
    more than it may lack in a text at the threshold. The first of them, ``early``, are one
    more than it may lack in a text of its size or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            name, text, _ = shingles(*flat(batch.column("text")), size)
            order = np.lexsort((name, counts[(name % U(PLACES)).astype(np.int64)], text))
            name, text = name[order], text[order]
            n = np.bincount(text, minlength=batch.num_rows)
            place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
            first = place < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[text]
            early = place < (n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1)[text]
            columns = [n[text], place, early, name.view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(text[first])), *[pa.array(c[first]) for c in columns]],
                names=["node", "n", "place", "early", "name"],
            )

    return run


def _open_pairs(
    members: DataFrame, labels: DataFrame | None, texts: DataFrame, size: int, threshold: float
) -> DataFrame | None:
    """Pairs ``a, b`` of members of open buckets in different groups, all that may reach the
    threshold; None without open buckets."""
    if labels is None:
        own = members.select("key", "node", F.col("node").alias("label"))
    else:
        own = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    own = stored(own, "own")
    apart = own.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    apart = stored(apart.where("least != most").select("key"), "apart").hint("merge")
    nodes = stored(own.join(apart, "key").select("node", "label").distinct(), "open")
    discard(own)
    if nodes.isEmpty():
        return None
    nodes = nodes.hint("merge")
    wanted = stored(texts.join(nodes, "node").select("node", "label", "text"), "open-texts")
    counts = np.zeros(PLACES, np.int64)
    # A row a place.
    for place, n in wanted.select("text").mapInArrow(_rarity(size), "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        counts[place] = n
    prefixes = wanted.select("node", "text").mapInArrow(_prefixes(size, threshold, counts), "node binary, n long, place long, early boolean, name long")
    shared = stored(prefixes, "prefixes")
    often = shared.groupBy("name").agg(F.count(F.lit(1)).alias("texts"), F.max("early").alias("any"))
    often = stored(often.where("texts > 1 AND any").select("name"), "names").hint("merge")
    shared = stored(shared.join(often, "name").join(nodes, "node").select("name", "node", "n", "place", "early", "label"), "shared")
    # The shorter text meets the other one by an early shingle; what both have left from the
    # shared one on must do for as many shingles as they need in common.
    one, two = shared.where("early").alias("x"), shared.hint("merge").alias("y")
    least = f"{threshold!r}D * (x.n + y.n) - 1e-9D"
    met = (
        "x.name = y.name AND (x.n < y.n OR (x.n = y.n AND x.node < y.node)) AND x.label != y.label "
        f"AND {1 + threshold!r}D * least(x.n - x.place, y.n - y.place) >= {least}"
    )
    pairs = one.join(two, F.expr(met)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = stored(pairs.distinct(), "met")
    marks = stored(wanted.select("node", "text").mapInArrow(_marks(size), "node binary, n long, hidden long, marks array<long>"), "marks")
    x, y = (marks.hint("merge").select(F.col("node").alias(c), F.struct("n", "hidden", "marks").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    # Two texts share a shingle at most for each place that both have, and for each shingle
    # of the one that its marks hide.
    places = " + ".join(f"bit_count(x.marks[{i}] & y.marks[{i}])" for i in range(MARKS // 64))
    near = f"{1 + threshold!r}D * ({places} + least(x.hidden, y.hidden)) >= {least}"
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b")


def link_classes(
    rows: DataFrame, classes: DataFrame, size: int, threshold: float, bands: int, height: int
) -> DataFrame | None:
    """``node, label`` of every class with a near copy; None without any."""
    members = _buckets(rows, size, bands, height)
    # What is needed grows with the rows, so it is never broadcast, however small it is.
    needed = stored(classes.join(members.select("node").distinct(), "node").select("row"), "needed").hint("merge")
    texts = rows.select("row", "node", "text").join(needed, "row").dropDuplicates(["row"]).select("node", "text")
    texts = stored(texts, "texts")
    labels = links = None
    members = others = _with_pivots(members)
    while True:
        apart = members if labels is None else _outside(members, labels)
        pairs = apart.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        found = stored(verify(pairs, texts, size, threshold), "links")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = components(links, labels)
        members = _with_pivots(_outside(members, labels))
    # Members have been compared with their pivots, not with one another.
    pairs = _open_pairs(others, labels, texts, size, threshold)
    if pairs is None:
        return labels
    found = stored(verify(stored(pairs, "pairs"), texts, size, threshold), "links")
    if found.isEmpty():
        return labels
    return components(found if links is None else links.union(found), labels)


def judge_classes(
    rows: DataFrame,
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    height: int = ROWS,
) -> DataFrame:
    """One row per class: ``node, row`` (the row that stands for it), ``class_id``,
    ``group_id``, ``n_copies``, and ``first`` if it stands for its group."""
    own = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    classes = stored(
        rows.groupBy("node")
        .agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("n_copies"))
        .select("node", "n_copies", "own", F.col("own.row").alias("row")),
        "classes",
    )
    labels = link_classes(rows, classes, size, threshold, bands, height)
    if labels is None:
        judged = classes.withColumn("chosen", F.col("own"))
    else:
        label = F.coalesce("label", "node").alias("label")
        labelled = stored(classes.join(labels, "node", "left").select("node", "n_copies", "own", "row", label), "labelled")
        chosen = stored(labelled.groupBy("label").agg(F.min("own").alias("chosen")), "chosen")
        judged = labelled.join(chosen, "label")
    return stored(
        judged.select(
            "node",
            "row",
            F.col("own.id").alias("class_id"),
            F.col("chosen.id").alias("group_id"),
            "n_copies",
            (F.col("chosen.row") == F.col("row")).alias("first"),
        ),
        "judged",
    )


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: the id column, ``class_id`` (least id among equal texts),
    ``group_id`` (least id among all that are linked), ``n_copies`` (rows with this text) and
    ``kept`` (it stands for its group). ``options`` as for ``judge_classes``."""
    rows = _rows(docs, id_col, text_col)
    judged = judge_classes(rows, **options).withColumnRenamed("row", "own")
    return (
        rows.select("id", "node", "row")
        .join(judged, "node")
        .select(
            F.col("id").alias(id_col),
            "class_id",
            "group_id",
            "n_copies",
            (F.col("first") & (F.col("row") == F.col("own"))).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns."""
    kept = judge_classes(_rows(docs, id_col, text_col), **options).where("first").select("row")
    plain, (id_, text) = numbered(docs, id_col, text_col)
    whole = plain.withColumn("row", row_key(F.col(id_), _text(text)))
    return whole.join(kept, "row").dropDuplicates(["row"]).select(*plain.columns).toDF(*docs.columns)
