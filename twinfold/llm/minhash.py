"""Near-duplicates by an inverted join of MinHash signature coordinates.

Each text has a set of word shingles and a signature of ``COORDINATES`` minima.
Texts are posted under each (coordinate, value) pair.  Two texts of the wanted
similarity agree in at least ``MATCHES`` coordinates (but for one pair in
40 million of those that are exactly at 0.75), which gives three kinds of lists:

* Values of one text only cannot collide and are not posted.
* *Prefix*: of the other values a text posts the rarest only, so many that two
  texts with enough matches share one of them.
* *Skipped*: lists of more than ``LONG_LIST`` texts (a passage that many texts
  share, a large group of near copies) are not joined.  A text with fewer than
  ``MATCHES`` values in such lists must share a short list as well.  Texts with
  more of them, the *crowded* ones, are also compared by an exact way: a prefix
  filter over their shingles, the rarest first, which loses nothing.

Candidates whose signatures agree in ``MATCHES`` coordinates are confirmed on the
full shingle sets.  Equal sets are folded first.  Groups are not expanded into
all pairs: each text is first compared with its best partner or the head of a
shared list, and afterwards only texts of different components are compared, so
no link between components is lost.

Defined results: A-Z are lower-cased; a text of fewer words than a shingle has
its whole sequence as its only shingle; null and empty texts and texts without
words have none and are linked with nothing, and so are rows without an id.
Repeated rows with one id are one document.  An empty table gives an empty
result.  Extra columns are ignored by :func:`near_duplicates` and carried along
by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.bytestext import chunks, constants, mix, shingle_sets, small_batches
from twinfold.operators.cluster import connected_components
from twinfold.sources.lineage import stored

SHINGLE, PERCENT = 5, 75  # words; intersection per hundred of the union
COORDINATES, MATCHES = 64, 28
LONG_LIST = 32
_U32 = np.uint64(32)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each (non-empty) set."""
    if not sets:
        return np.zeros((0, COORDINATES), np.int32)
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    times, plus = constants(COORDINATES, 101), constants(COORDINATES, 202)
    out = np.empty((len(sets), COORDINATES), np.int32)
    for j in range(COORDINATES):
        out[:, j] = np.minimum.reduceat((values * times[j] + plus[j]) >> _U32, starts).astype(np.uint32).view(np.int32)
    return out


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``<id>, n_shingles, set_a, set_b`` (together the identity of the set) and ``sig array<int>`` (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in chunks(batch.column(text_column)):
                sets = shingle_sets(chunk, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                names = np.zeros((2, len(sets)), np.uint64)
                for k in range(2):
                    names[k, full] = [mix(sets[i] + np.uint64(k + 1)).sum(dtype=np.uint64) for i in full]
                counts = np.array([len(s) for s in sets], np.int64)
                offsets = np.concatenate(([0], np.cumsum(np.where(counts > 0, COORDINATES, 0)))).astype(np.int32)
                sig = pa.ListArray.from_arrays(offsets, pa.array(_signatures([sets[i] for i in full]).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column).slice(at, len(sets)), pa.array(counts), pa.array(names[0].view(np.int64)),
                     pa.array(names[1].view(np.int64)), sig], [id_column, "n_shingles", "set_a", "set_b", "sig"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_shingles long, set_a long, set_b long, sig array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """``rep, shingles array<bigint>`` (sorted) of the documents in ``wanted`` (one column ``rep``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in chunks(batch.column("text")):
                sets = [np.sort(s.view(np.int64)) for s in shingle_sets(chunk, shingle)]
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(at, len(sets)),
                                                  pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["rep", "shingles"])

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("rep"), F.col(text_column).alias("text")).join(wanted, "rep", "left_semi")
    return texts.mapInArrow(run, f"rep {kind}, shingles array<bigint>").dropDuplicates(["rep"])


def _shared_values(reps: DataFrame) -> DataFrame:
    """``rep, values array<struct<n, value>>``: the values that other texts have too, the rarest first; with at least ``MATCHES``."""
    value = F.transform("sig", lambda v, i: F.shiftleft(i.cast("bigint"), 32) + F.shiftrightunsigned(F.shiftleft(v.cast("bigint"), 32), 32))
    posted = reps.select("rep", F.explode(value).alias("value"))
    lists = stored(posted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    return (posted.join(lists, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("values"))
            .filter(F.size("values") >= MATCHES))


def _short_list_pairs(own: DataFrame, reps: DataFrame) -> DataFrame:
    """``u, v, matches`` (u < v): texts that share a short list and agree in ``MATCHES`` coordinates or more."""
    short = F.filter("values", lambda x: x["n"] <= LONG_LIST)
    skipped = F.size("values") - F.size("short")
    # a partner agrees in this many of the short lists at least, one of them in the prefix
    least = F.greatest(MATCHES - skipped, F.lit(1))
    prefix = F.slice("short", 1, F.greatest(F.size("short") - least + 1, F.lit(0)))
    posts = own.withColumn("short", short).select("rep", F.explode(F.transform(prefix, lambda x: x["value"])).alias("value"))
    a, b = posts.select("value", F.col("rep").alias("u")), posts.select("value", F.col("rep").alias("v"))
    met = a.join(b, "value").filter("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("met"))
    sig = reps.select("rep", "sig")
    both = (met.join(sig.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u")), "u")
            .join(sig.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v")), "v"))
    agree = F.size(F.filter(F.zip_with("sig_u", "sig_v", lambda x, y: x == y), lambda x: x))
    return both.select("u", "v", agree.alias("matches")).filter(F.col("matches") >= MATCHES)


def _overlap(m: str, n: str) -> Column:
    """How many shingles two sets of ``m`` and ``n`` share at least if they are similar enough."""
    return F.ceil(PERCENT * (F.col(m) + F.col(n)) / (100 + PERCENT)).cast("int")


def _crowded_posts(crowded: DataFrame) -> DataFrame:
    """``rep, n, rare, at, shingle``: the first shingles of each crowded text and their places, from 0.

    All texts order shingles alike: those in few crowded texts first (``rare`` of
    them), then by value.  Two texts that share ``o`` shingles have one in common
    among the first ``n - o + 1`` of either.
    """
    every = crowded.select("rep", F.explode("shingles").alias("shingle"))
    long = stored(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LONG_LIST).select("shingle"), "long-lists")
    rare = every.join(long, "shingle", "left_anti").groupBy("rep").agg(F.array_sort(F.collect_list("shingle")).alias("rare"))
    none = F.expr("cast(array() as array<bigint>)")
    size = F.size("shingles")
    ordered = (crowded.join(rare, "rep", "left").withColumn("rare", F.coalesce("rare", none))
               .withColumn("n", size).withColumn("length", size - F.ceil(size * PERCENT / 100).cast("int") + 1))
    common = F.when(F.size("rare") < F.col("length"), F.slice(F.array_except("shingles", "rare"), 1, F.greatest(F.col("length") - F.size("rare"), F.lit(1))))
    chosen = F.concat(F.slice("rare", 1, F.col("length")), F.coalesce(common, none))
    return ordered.select("rep", "n", F.size("rare").alias("rare"), F.posexplode(chosen).alias("at", "shingle"))


def _heads(posts: DataFrame) -> DataFrame:
    """``u, v``: each crowded text with the list head that it meets most often; a head has the fewest rare shingles of its list."""
    head = F.min(F.struct("rare", "rep")).alias("head")
    heads = posts.groupBy("shingle").agg(head, F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle", F.col("head.rep").alias("head"))
    met = (posts.join(stored(heads, "heads"), "shingle").filter(F.col("rep") != F.col("head")).groupBy("rep", "head").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("rep").agg(F.max(F.struct("n", (-F.col("head")).alias("back"))).alias("best")))
    return met.select((-F.col("best.back")).alias("u"), F.col("rep").alias("v"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b"))
    same = F.size(F.array_intersect("a", "b")).cast("bigint")
    return (pairs.join(a, "u").join(b, "v").select("u", "v", same.alias("same"), (F.size("a") + F.size("b")).cast("bigint").alias("both"))
            .filter((F.col("same") > 0) & (100 * F.col("same") >= PERCENT * (F.col("both") - F.col("same")))).select("u", "v"))


def _across(posts: DataFrame, components: DataFrame) -> DataFrame:
    """``u, v`` (u < v): crowded texts of different components that may be similar enough.

    In a pair of ``m`` and ``n`` shingles (m <= n) both must have a common shingle
    among the first that :func:`_overlap` leaves: for the smaller text these are
    a seventh of its shingles.  The larger one is posted under the sizes that
    its list has smaller texts of.
    """
    labelled = posts.join(components, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labelled = stored(labelled, "crowded-posts")
    mixed = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    inside = labelled.join(stored(mixed.select("shingle"), "mixed-lists"), "shingle", "left_semi")
    small = inside.filter(F.col("at") <= F.col("n") - _overlap("n", "n")).withColumn("m", F.col("n"))
    sizes = stored(small.groupBy("shingle").agg(F.collect_set("n").alias("sizes")), "list-sizes")
    fits = "m -> m <= n and 100 * m >= {0} * n and at <= n - ceil({0} * (m + n) / (100 + {0}))".format(PERCENT)
    large = inside.join(sizes, "shingle").withColumn("m", F.explode(F.expr(f"filter(sizes, {fits})")))
    a, b = small.alias("a"), large.alias("b")
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.m") == F.col("b.m")) & (F.col("a.component") != F.col("b.component"))
                 & ((F.col("a.n") < F.col("b.n")) | (F.col("a.rep") < F.col("b.rep"))))
    return met.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct()


def links(docs: DataFrame, reps: DataFrame, id_column: str, text_column: str, shingle: int = SHINGLE) -> DataFrame:
    """``rep, component``: components of the similarity graph among the texts with partners."""
    own = stored(_shared_values(reps), "shared-values")
    pairs = stored(_short_list_pairs(own, reps), "pairs")
    skipped = F.size(F.filter("values", lambda x: x["n"] > LONG_LIST))
    crowd = own.filter(skipped >= MATCHES).select("rep")
    wanted = crowd.union(pairs.select("u")).union(pairs.select("v")).distinct()
    sets = stored(full_sets(docs, stored(wanted, "wanted"), id_column, text_column, shingle), "sets")
    posts = stored(_crowded_posts(sets.join(crowd, "rep", "left_semi")), "posts")

    best = pairs.groupBy("v").agg(F.max(F.struct("matches", -F.col("u"))).alias("best"))
    first = best.select((-F.col("best").getField("col2")).alias("u"), "v").union(_heads(posts))
    tried = stored(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "tried")
    found = stored(_confirmed(tried, sets), "found")
    parts = stored(connected_components(found, "u", "v").withColumnRenamed("record_id", "rep"), "parts")

    of = {x: parts.select(F.col("rep").alias(x), F.col("component").alias(f"of_{x}")) for x in ("u", "v")}
    apart = (pairs.select("u", "v").join(of["u"], "u", "left").join(of["v"], "v", "left")
             .filter(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v"))
    rest = apart.union(_across(posts, parts)).distinct().join(tried, ["u", "v"], "left_anti")
    more = stored(_confirmed(rest, sets), "found-apart")
    if more.isEmpty():
        return parts
    return connected_components(found.union(more), "u", "v").withColumnRenamed("record_id", "rep")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``<id>, n_shingles, component_id, kept`` for each row; the smallest id of a component stays."""
    small_batches(docs.sparkSession)
    sketched = stored(sketches(docs, id_column, text_column, shingle), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    some = sketched.filter(F.col(id_column).isNotNull() & (F.col("n_shingles") > 0))
    reps = stored(some.groupBy(*key).agg(F.min(id_column).alias("rep"), F.first("sig").alias("sig")), "reps")
    parts = links(docs, reps, id_column, text_column, shingle)
    named = stored(reps.select(*key, "rep").join(parts, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id")), "named")
    alone = sketched.filter(F.col(id_column).isNull() | (F.col("n_shingles") == 0)).select(
        id_column, "n_shingles", F.col(id_column).alias("component_id"))
    out = some.join(named, key).select(id_column, "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each component."""
    gone = near_duplicates(docs, id_column, text_column, shingle).filter(~F.col("kept")).select(id_column)
    return docs.join(stored(gone.distinct(), "gone"), id_column, "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
p AS (SELECT doc_id, k FROM s JOIN ids USING (s)),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(na.n) + max(nb.n) - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
