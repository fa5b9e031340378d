"""N-gram Jaccard join by a grouped prefix join.

A document's set holds the hashes of its distinct runs of five words. Two documents link when their sets' Jaccard likeness is PERCENT or more.

1. ``shared_counts``: in one pass over the texts, how many of a document's shingles occur in another document. A document
   under PERCENT of shared shingles links with nothing and stops here.
2. Documents with equal sets are one class; the smallest doc_id goes on, with its full set. Shingles are ordered from the rarest on; those of one
   document only come first. By pigeonhole two linked sets have one of their first n - ceil(PERCENT * n) + 1 shingles in common, of which only the shared ones
   matter.
3. Sets with the same size and the same prefix are one group. Groups that have a prefix shingle in common meet if their sizes, and what is left of both from
   there on, allow a link. Under a shingle with at most FEW groups all of them meet at once; under a frequent one all meet
   the group with the smallest id. Group pairs are expanded to their smallest members, and members meet the smallest one of their own group; these
   pairs are verified on full sets.
4. Only what is still apart is compared further: the members of group pairs, and of frequent shingles, that lie in several components,
   in blocks of sets of like size and only across components; blocks whose sizes and shared shingles allow no link don't meet. Frequent shingles with the same
   groups are one. So copies and families that hang together cost a few rows a member.

Null texts and texts without words have empty sets and link with nothing, as do rows without a doc_id. Rows with the same doc_id are
judged each by its own set; different sets that one doc_id stands for count as one document in the links. Extra columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, join_hot, written
from .graph import components, merged
from .set_blocks import confirmed, linked_pairs, links_across
from .shingle_sets import full_sets, least_shared, shared_counts

PERCENT = 80
#: Groups under a shingle that all meet at once.
FEW = 32


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, n, shared, prefix): of sets (id, n, hashes) that can have links among each other, the shared shingles of their prefix, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                hashes = [np.frombuffer(v, dtype="<i8") for v in part.column("hashes").to_pylist()]
                each = pa.array(np.repeat(np.arange(part.num_rows), [len(h) for h in hashes]))
                yield pa.RecordBatch.from_arrays([part.column("id").take(each), part.column("n").take(each), pa.array(np.concatenate(hashes))], names=["id", "n", "token"])

    tokens = sets.mapInArrow(run, "id long, n long, token long")
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    mine = tokens.join(df, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    size = F.size("t").cast("long")
    mine = mine.withColumn("shared", size).where(size >= least_shared(F.col("n"), percent))
    return mine.select("id", "n", "shared", F.slice("t", F.lit(1), (F.col("shared") - least_shared(F.col("n"), percent) + 1).cast("int")).alias("prefix"))


def _may_link(a: str, b: str, percent: int) -> F.Column:
    """Whether sizes, and what is left from a common shingle on, allow a link: 2 * percent for both in the overlap of at most ``left``."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * F.least(f"left_{a}", f"left_{b}") >= percent * (n_a + n_b))


def linked_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the links among sets (id, n, hashes); ids without links are left out."""
    found = written(prefixes(sets, percent), "prefixes")
    named = found.select("id", "n", "shared", F.xxhash64("n", F.transform("prefix", lambda t: t["token"])).alias("name"))
    members = written(join_hot(named, named.groupBy("name").agg(F.min("id").alias("gid")), "name", "id").select("id", "gid", "n", "shared"), "members")
    groups = found.join(members.where("id = gid").select("id"), "id", "left_semi")
    entries = groups.select(F.col("id").alias("gid"), "n", "shared", F.posexplode("prefix").alias("place", "t"))
    entries = written(entries.select("gid", "n", (F.col("shared") - F.col("place")).alias("left"), F.col("t.token").alias("token")), "entries")

    tokens = entries.groupBy("token").agg(F.count("*").alias("groups"), F.min("gid").alias("lead"), F.bit_xor(F.xxhash64("gid")).alias("x"), F.sum(F.xxhash64("gid").cast("decimal(38,0)")).alias("y")).where("groups > 1")
    tokens = written(tokens, "prefix-tokens")
    rare, often = tokens.where(F.col("groups") <= FEW).select("token"), tokens.where(F.col("groups") > FEW)
    some = entries.join(rare, "token", "left_semi")
    sides = [some.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "left"))) for s in "ab"]
    pairs = sides[0].join(sides[1], "token").where((F.col("gid_a") < F.col("gid_b")) & _may_link("a", "b", percent)).select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b")).distinct()
    pairs = written(pairs, "group-pairs")

    to_lead = join_hot(entries, often.select("token", "lead"), "token", "gid").where("gid <> lead").select(F.col("lead").alias("a"), F.col("gid").alias("b"))
    own = members.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    links = linked_pairs(pairs.unionByName(to_lead).unionByName(own).distinct(), sets, percent)
    labels = written(components(links), "labels")

    label = F.coalesce("component", "id").alias("label")
    labelled = written(members.join(labels, "id", "left").select("id", "gid", "n", "shared", label), "labelled")
    keyed = pairs.select(F.xxhash64("a", "b").alias("k"), F.explode(F.array("a", "b")).alias("gid")).unionByName(members.select(F.xxhash64("gid").alias("k"), "gid").distinct())
    once = often.groupBy("groups", "x", "y").agg(F.min("token").alias("token")).select("token")
    keyed = keyed.unionByName(entries.join(once, "token", "left_semi").select(F.col("token").alias("k"), "gid"))
    keyed = written(keyed, "keys")
    spans = labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    apart = join_hot(keyed, spans, "gid", "k").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("k")
    rows = join_hot(keyed, apart, "k", "gid").join(labelled, "gid").select("k", "id", "label", "n", "shared")
    more = links_across(written(rows.distinct(), "apart"), sets.select("id", "hashes"), percent, confirmed(percent))
    return merged(labelled.select("id", F.col("label").alias("component")), more)


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = id_and_text(docs)
    found = written(shared_counts(docs), "shared-counts")
    named = found.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(named.groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("shared").alias("shared")), "classes")
    live = classes.where(F.col("shared") >= least_shared(F.col("n"), percent)).select("id").distinct()
    sets = written(full_sets(docs, live), "sets")
    linked = linked_components(sets, percent)
    # a doc_id may stand for several sets where ids repeat: the joins by id then bring all of them
    over = classes.join(linked, "id").where("component <> id").select("key", "component")
    out = join_hot(named, classes.select("key", "id"), "key", "doc_id").join(over, "key", "left")
    whole = out.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return whole.unionByName(found.where(F.col("key").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
