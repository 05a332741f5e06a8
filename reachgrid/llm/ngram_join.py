"""N-gram Jaccard join by groups of identical prefixes.

Documents become sets of word shingles. Equal sets are one class. Classes whose
size and prefix (their rarest shingles) agree are one group, so near copies
share their index entries. Groups that share a prefix shingle and pass the
length and positional filters are candidates; they are expanded to their
members, and each pair of members is checked on the whole sets.

Components need no more links than hold them together, so large buckets cost
no square: first each group is checked against one pivot of each of its
buckets and each member against its group; only members that are then still in
different components meet each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reachgrid.llm.components import components
from reachgrid.llm.rarity import frequencies, keys_of
from reachgrid.llm.setjoin import may_match, prefix_length, verified
from reachgrid.llm.texts import portions, text_key, without, written
from reachgrid.llm.words import LOWER, U, WHITE, longs, mix, read_words, text_grams
from reachgrid.operators.sizes import if_small

#: Hashed counters of shingles, one byte each in every task.
RARITY_BITS = 22


def _sets(column: pa.Array, k: int):
    """Distinct shingle hashes of each text, in order of the rows."""
    for i, j, words in read_words(column, WHITE, LOWER):
        hashes, bounds = text_grams(words, k)
        for r in range(j - i):
            yield np.unique(hashes[bounds[r] : bounds[r + 1]])


def _signatures(docs: DataFrame, codes, k: int, num: int, den: int) -> DataFrame:
    def sign(batches):
        for batch in portions(batches):
            n, one, two, head, keys = [], [], [], [], []
            for hashes in _sets(batch.column(0), k):
                n.append(len(hashes))
                one.append(int(mix(hashes).sum(dtype=U)))
                two.append(int(mix(hashes ^ U(0x5BD1E995)).sum(dtype=U)))
                prefix = np.sort(keys_of(hashes, codes.value))[: prefix_length(len(hashes), num, den) if len(hashes) else 0]
                keys.append(prefix)
                head.append(int(mix(prefix ^ mix(np.arange(len(prefix), dtype=U))).sum(dtype=U)))
            flat = np.concatenate(keys) if keys else np.zeros(0, U)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            signed = [pa.array(np.array(x, dtype=U).astype(np.int64)) for x in (n, one, two, head)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *signed, longs(flat, bounds)], names=["doc", "k1", "k2", "n", "fp1", "fp2", "head", "keys"]
            )

    narrow = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc"), *text_key(F.col("text")))
    schema = "doc long, k1 long, k2 long, n long, fp1 long, fp2 long, head long, keys array<long>"
    signed = narrow.mapInArrow(sign, schema)
    return written(signed.withColumn("rid", F.monotonically_increasing_id()), "signatures")


def _whole_sets(docs: DataFrame, wanted: DataFrame, codes, k: int, repeats: bool) -> DataFrame:
    """(id, keys) of the wanted classes (id, doc, k1, k2), from the texts of their first documents.

    With *repeats* some rows give doc_id and text again, and so their set.
    """

    def sets(batches):
        for batch in portions(batches):
            keys = [np.sort(keys_of(h, codes.value)) for h in _sets(batch.column(0), k)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), longs(np.concatenate(keys) if keys else np.zeros(0, U), bounds)], names=["id", "keys"]
            )

    texts = docs.select("text", F.col("doc_id").cast("long").alias("_doc"), *text_key(F.col("text")))
    w = if_small(wanted).alias("w")
    same = (F.col("_k1") == F.col("w.k1")) & (F.col("_k2") == F.col("w.k2")) & F.col("_doc").eqNullSafe(F.col("w.doc"))
    found = texts.join(w, same).select("text", F.col("w.id").alias("id")).mapInArrow(sets, "id long, keys array<long>")
    if repeats:
        found = found.groupBy("id").agg(F.first("keys").alias("keys"))
    return written(found, "sets")


def link(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, rarity_bits: int = RARITY_BITS) -> DataFrame:
    """(rid, doc_id, n_shingles, class_id, component_id, component_rid, n_class, k1, k2) of every row of *docs* (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of *k*-word
    shingles is at least num / den. Words are runs of non-white bytes, A-Z
    lower-cased; a text of fewer words is one shingle. Shingles are 64-bit
    hashes. component_id is the least doc_id that links reach, component_rid
    the least row number (rid) of the component, class_id that of the equal
    sets.

    Null or empty texts and texts without words have no shingles and are alone:
    component_id is their own doc_id. A null doc_id counts for links but is
    never a component_id, unless nothing else is in the component. Repeated
    rows each get a row. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")

    def occurrences(column):
        for _, _, words in read_words(column, WHITE, LOWER):
            yield text_grams(words, k)[0]

    codes = spark.sparkContext.broadcast(frequencies(docs.select("text"), occurrences, rarity_bits))
    signed = _signatures(docs, codes, k, num, den)
    linked = _linked(docs, signed, codes, k, num, den)
    # All that needs them is written.
    codes.destroy()
    return linked


def _linked(docs: DataFrame, signed: DataFrame, codes, k: int, num: int, den: int) -> DataFrame:
    some = signed.where("n > 0")
    classes = written(
        some.groupBy("n", "fp1", "fp2", "head").agg(F.min("rid").alias("cls"), F.min("doc").alias("first_doc"), F.count("*").alias("copies")),
        "classes",
    )
    groups = classes.groupBy("n", "head").agg(F.min("cls").alias("gid"), F.sum("copies").alias("weight"))
    members = written(classes.join(groups, ["n", "head"]).select("cls", "gid", "weight", "n"), "members")

    leads = members.where("cls = gid").select("gid", "weight")
    # Nearly all rows lead a group, so the few that do not are taken out.
    others = if_small(written(some.select("rid").join(leads.select(F.col("gid").alias("rid")), "rid", "left_anti"), "not-leads"))
    heavy = if_small(leads.where("weight > 1").withColumnRenamed("gid", "rid"))
    lead_keys = some.select("rid", "n", "keys").join(others, "rid", "left_anti").join(heavy, "rid", "left")
    tokens = lead_keys.select(
        F.col("rid").alias("gid"), F.col("n").cast("int").alias("n"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), F.posexplode("keys").alias("pos", "key")
    )
    # Most keys are in one group alone; they go before anything else moves with them.
    shared = tokens.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    hits = written(tokens.join(shared, "key").select("key", "gid", F.col("n").cast("long").alias("n"), "pos", "weight"), "hits")
    # The pivot of a bucket is the group with most copies: near copies are likely near the copied text.
    best = F.max(F.struct("weight", (-F.col("gid")).alias("_no"), "n", "pos")).alias("pivot")
    pivots = hits.groupBy("key").agg(best).select("key", (-F.col("pivot._no")).alias("lead"), "pivot.n", "pivot.pos")
    h, v = hits.alias("h"), pivots.alias("v")
    near = may_match(F.col("h.n"), F.col("h.pos"), F.col("v.n"), F.col("v.pos"), num, den)
    star = h.join(v, (F.col("h.key") == F.col("v.key")) & (F.col("h.gid") != F.col("v.lead")) & near).select(
        F.col("v.lead").alias("a"), F.col("h.gid").alias("b")
    )
    inside = members.where("cls != gid").select(F.col("gid").alias("a"), F.col("cls").alias("b"))
    first = written(star.unionByName(inside).distinct(), "star-pairs")
    edges, sets = _checked(docs, signed, first, codes, k, num, den)

    part = components(edges)
    placed = (
        members.join(part, members.cls == part.node, "left")
        .select("cls", "gid", "n", F.coalesce("component", "cls").alias("comp"))
    )
    units = placed.select("gid", "comp").distinct()
    entries = hits.select("key", "gid", "n", "pos").join(units, "gid")
    open_keys = entries.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("key")
    entries = written(entries.join(open_keys, "key"), "open-buckets")
    x, y = entries.alias("x"), entries.alias("y")
    apart = (F.col("x.comp") < F.col("y.comp")) & (F.col("x.gid") != F.col("y.gid"))
    bound = may_match(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), num, den)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & bound).select(
        F.col("x.gid").alias("ga"), F.col("x.comp").alias("ca"), F.col("y.gid").alias("gb"), F.col("y.comp").alias("cb")
    ).distinct()
    of_a = placed.select(F.col("gid").alias("ga"), F.col("comp").alias("ca"), F.col("cls").alias("a"))
    of_b = placed.select(F.col("gid").alias("gb"), F.col("comp").alias("cb"), F.col("cls").alias("b"))
    rest = met.join(of_a, ["ga", "ca"]).join(of_b, ["gb", "cb"]).select("a", "b").unionByName(_inside(placed, sets, num, den))
    tried = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    if not rest.isEmpty():
        found, _ = _checked(docs, signed, rest, codes, k, num, den)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            part = components(edges)

    least = written(
        classes.join(part, classes.cls == part.node, "left").select("n", "fp1", "fp2", "cls", "first_doc", F.coalesce("component", "cls").alias("comp")),
        "class-components",
    )
    first_of = least.groupBy("comp").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("n_class"))
    by_class = least.join(first_of, "comp")
    rows = signed.select("rid", "doc", "k1", "k2", "n", "fp1", "fp2").join(by_class, ["n", "fp1", "fp2"], "left")
    return rows.select(
        "rid",
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("cls", "rid").alias("class_id"),
        F.when(F.col("comp").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("comp", "rid").alias("component_rid"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
        "k1",
        "k2",
    )


def _inside(placed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): members of one group that are in different components and may match.

    They have one size and one prefix, so what a match still needs must come from
    the keys behind it: the first of those are a prefix in their turn.
    """
    torn = placed.groupBy("gid").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("gid")
    n = F.col("n")
    needed = F.ceil(2 * num * n / F.lit(den + num))
    head = n - F.ceil(num * n / F.lit(den)) + 1
    behind = F.slice("keys", (head + 1).cast("int"), F.greatest(n - needed + 1, F.lit(1)).cast("int"))
    open_sets = placed.join(torn, "gid").join(sets, F.col("cls") == F.col("id"))
    entries = open_sets.select("gid", "cls", "comp", F.explode(behind).alias("key"))
    split = entries.groupBy("gid", "key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("gid", "key")
    entries = written(entries.join(split, ["gid", "key"]), "open-members")
    x, y = entries.alias("x"), entries.alias("y")
    met = x.join(y, (F.col("x.gid") == F.col("y.gid")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")))
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _checked(docs: DataFrame, signed: DataFrame, pairs: DataFrame, codes, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that match, sets of their ends)."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = signed.select(F.col("rid").alias("id"), "doc", "k1", "k2").join(ends, "id")
    repeats = not signed.groupBy("doc", "k1", "k2").count().where("count > 1").isEmpty()
    sets = _whole_sets(docs, wanted, codes, k, repeats)
    return written(verified(pairs, sets, num, den), "links"), sets


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """*docs* with one document of each component: the one of least doc_id (nulls last), then of least text hash.

    Rows without shingles all stay. Rows that repeat both doc_id and text are
    one document and stay or go together. All columns are kept.
    """
    linked = link(docs, k, num, den).where("n_shingles > 0")
    me = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), "k1", "k2")
    best = linked.groupBy("component_rid").agg(F.min(me).alias("best"), F.max(me).alias("worst")).where("best != worst")
    gone = linked.join(best, "component_rid").where(me != F.col("best")).select(F.col("doc_id").alias("doc"), "k1", "k2").distinct()
    return without(docs, gone)
