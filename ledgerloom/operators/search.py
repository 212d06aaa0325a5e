"""Full-text search: postings, corpus statistics, BM25, and the channels around it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import search_tokens, terms_of
from ledgerloom.session import cut, exists

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: By so much a product of floats may miss the number that it stands for.
EDGE = 1e-9


def _counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, dl, terms): length and counted terms of each document; a sort within each document, no shuffle.

    Lambdas over one-element arrays bind what is used more than once, so it is made once a document.
    """

    def counted(sorted_: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(sorted_)), lambda i: (i == 1) | (F.get(sorted_, i - 1) != F.get(sorted_, i - 2)))
        end = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(sorted_) + 1)
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct(F.get(sorted_, i - 1).alias("term"), (end(b, k) - i).cast("long").alias("tf"))))[0]

    tokens = search_tokens(F.coalesce(F.col(text), F.lit("")))
    one = F.transform(F.array(F.sort_array(tokens)), lambda t: F.struct(F.size(t).cast("long").alias("dl"), F.when(F.size(t) > 0, counted(t)).alias("terms")))[0]
    return docs.select(F.col(doc_id).alias("doc_id"), one.alias("one")).select("doc_id", "one.dl", "one.terms")


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf): how often each term occurs in each document."""
    return _counted(docs, doc_id, text).select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.tf")


def document_lengths(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.size(search_tokens(F.col(text))), F.lit(0)).cast("long").alias("dl"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _idf(docs: Column, df: Column) -> Column:
    idf = F.log((docs - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf)


def _scores(posted: DataFrame, docs: Column, average: Column) -> DataFrame:
    """(doc_id, score) from the postings (doc_id, term, tf, dl) of a query's terms."""
    df = posted.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # one row a term of the query
    one = _idf(docs, F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    return posted.join(F.broadcast(df), "term").groupBy("doc_id").agg((-F.sum(one)).alias("score"))


def bm25(docs: DataFrame, doc_id: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(doc_id, score) of a table that has no index: score is lower for better documents, as a search engine's `bm25()` has it."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).where(F.lit(False))
    tokens = docs.select(F.col(doc_id).alias("doc_id"), search_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    total = tokens.agg(F.count("*").cast("double"), F.avg(F.size("tokens"))).first()
    wanted = F.array_intersect("tokens", F.array(*map(F.lit, terms)))
    hits = tokens.select("doc_id", "tokens", F.size("tokens").alias("dl"), F.explode(wanted).alias("term"))
    posted = hits.select("doc_id", "term", "dl", (F.size("tokens") - F.size(F.array_remove("tokens", F.col("term")))).alias("tf"))
    return _scores(posted, F.lit(total[0]), F.lit(total[1]))


# ---------------------------------------------------------------- the stored index

#: Parts of an index by a hash of the term, and of each part by a hash of the document.
PARTS, SPREAD = 32, 1


@dataclass(frozen=True)
class SearchIndex:
    """A version of a stored index: its postings (doc_id, term, tf, dl, part) and statistics."""

    spark: SparkSession
    postings: DataFrame
    documents: int
    average: float
    parts: int

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of some terms; only the parts that can hold them are read."""
        terms = list(dict.fromkeys(terms))
        if not terms:
            return self.postings.where(F.lit(False))
        part = F.pmod(F.xxhash64("t"), F.lit(self.parts))
        parts = [r["p"] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(part.alias("p")).distinct().collect()]  # one row a term
        return self.postings.where(F.col("part").isin(parts) & F.col("term").isin(terms))

    def bm25(self, terms: Sequence[str]) -> DataFrame:
        """(doc_id, score) of the documents with any of the terms; lower is better."""
        return _scores(self.of(terms), F.lit(float(self.documents)), F.lit(self.average))

    def overlap(self, terms: Sequence[str]) -> DataFrame:
        """(doc_id, n): how many of the terms a document has, where any."""
        return self.of(terms).groupBy("doc_id").agg(F.count("*").alias("n"))


def documents_digest(docs: DataFrame, doc_id: str, text: str) -> str:
    """A digest of a table of documents in any order: two sums of 64-bit hashes and the count."""
    one, two = F.xxhash64(doc_id, text), F.xxhash64(F.lit(7), doc_id, text)
    r = docs.agg(F.count("*"), F.sum(one.cast("decimal(20,0)")), F.sum(two.cast("decimal(20,0)"))).first()
    return f"{r[0]}:{r[1]}:{r[2]}"


def open_index(spark: SparkSession, path: str) -> SearchIndex | None:
    """The newest version of the index at path; None where there is none."""
    found = _newest(spark, path)
    if found is None:
        return None
    posted = spark.read.schema("doc_id long, term string, tf long, dl long, part long").parquet(found["folder"])
    return SearchIndex(spark, posted, found["documents"], found["average"], found["parts"])


def _newest(spark: SparkSession, path: str):
    """A version counts from when its line stands in the table of versions, which is written last."""
    if not exists(spark, f"{path}/versions"):
        return None
    return spark.read.schema("version long, folder string, digest string, documents long, average double, parts long").parquet(f"{path}/versions").orderBy(F.col("version").desc(), "folder").first()


def ensure_index(docs: DataFrame, doc_id: str, text: str, path: str, force: bool = False, parts: int = PARTS, spread: int = SPREAD) -> bool:
    """Whether a new version of the index at path was written: where the documents are not those of the newest one, or always.

    Texts are cut into terms once; the postings move once, to their part, and
    stand in order of term there, so that a query skips what it does not need.
    """
    spark, digest = docs.sparkSession, documents_digest(docs, doc_id, text)
    old = _newest(spark, path)
    if old is not None and old["digest"] == digest and not force:
        return False
    folder, n = f"{path}/{uuid.uuid4().hex}", int(digest.partition(":")[0])
    counted, seen = _counted(docs, doc_id, text), Observation()
    if n:  # plans over nothing are cut away, and what they observe with them
        counted = counted.observe(seen, F.avg("dl").alias("average"))
    posted = counted.select("doc_id", "dl", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.tf", "dl", F.pmod(F.xxhash64("t.term"), F.lit(parts)).alias("part"))
    spots = posted.repartition(parts * spread, "part", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).sortWithinPartitions("part", "term")
    spots.write.partitionBy("part").parquet(folder)
    average = float(seen.get["average"] or 0.0) if n else 0.0
    line = (1 + (old["version"] if old is not None else 0), folder, digest, n, average, parts)
    spark.createDataFrame([line], "version long, folder string, digest string, documents long, average double, parts long").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return True


# ---------------------------------------------------------------- channels


def top(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order that ends in a unique column."""
    return rows.orderBy(*order).limit(n)


def exact(docs: DataFrame, phrase: str, words: Sequence[str], names: Sequence[Column], ids: Sequence[Column], declares: Column, nameless: Column) -> DataFrame:
    """Rows that a query means: one of their names or ids is the whole phrase or, for declarations, among its words; nameless rows (modules) go by their ids only."""
    known = [F.when(~nameless, F.lower(n)) for n in names] + [F.lower(i) for i in ids]
    whole = F.greatest(*[F.coalesce(k == phrase, F.lit(False)) for k in known])
    among = F.greatest(*[F.coalesce(k.isin(*words), F.lit(False)) for k in known])
    return docs.where(whole | (declares & among))


def containing_path(docs: DataFrame, path: str, phrase: str) -> DataFrame:
    """Rows whose path contains the phrase, with `whole`: whether it is the phrase; backslashes count as slashes."""
    place = phrase.replace("\\", "/")
    return docs.where(F.contains(F.lower(F.col(path)), F.lit(place))).withColumn("whole", F.lower(F.col(path)) == place)


# Memory types that tell the state of a project, in order.
STATE_ORDER = ("goal", "task", "constraint", "blocker", "decision", "result", "question")


def project_state(rows: DataFrame, kind: str, valid_from: str, id_: str, current: Column, most: int = 30) -> DataFrame:
    """The first current rows of the types that tell a project's state: by type, newest first, then by id."""
    place = F.array_position(F.array(*map(F.lit, STATE_ORDER)), F.col(kind))
    return top(rows.where(current & (place > 0)), most, place, F.col(valid_from).desc(), F.col(id_))


def term_overlap(docs: DataFrame, id_: str, name: str, terms: Sequence[str]) -> DataFrame:
    """(id, overlap): how many query terms a name has, where any."""
    wanted = F.array(*map(F.lit, terms))
    n = F.size(F.array_intersect(terms_of(F.col(name)), wanted)).cast("long")
    return docs.select(F.col(id_).alias("id"), n.alias("overlap")).where("overlap > 0")


def ranked(rows: DataFrame, channel: str, id_: str, *order: Column) -> DataFrame:
    """(channel, id, rank, raw) of a bounded list, in its order."""
    return rows.select(F.lit(channel).alias("channel"), F.col(id_).alias("id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def reciprocal_rank_fusion(lists: DataFrame, k: float = 60.0) -> DataFrame:
    """(id, rrf, n_channels, rankings): sum of 1 / (k + rank) over channels; of a repeated id its first rank counts."""
    first = lists.groupBy("channel", "id").agg(F.min("rank").alias("rank"))
    return first.groupBy("id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.count("*").alias("n_channels"),
        F.array_sort(F.collect_list(F.struct("channel", "rank"))).alias("rankings"),
    )


def with_priority(fused: DataFrame) -> DataFrame:
    """Tiers: 0 explicit, 1 exact or a whole path, 2 reached by impact, 3 the rest."""
    channels = F.col("rankings.channel")
    tier = F.when(F.array_contains(channels, "explicit"), 0).when(F.arrays_overlap(channels, F.array(F.lit("exact"), F.lit("whole_path"))), 1).when(F.array_contains(channels, "reverse_impact"), 2).otherwise(3)
    return fused.withColumn("priority", tier)


def candidates(fused: DataFrame, most: int) -> DataFrame:
    """The first rows by tier, fused score and id, with their relevance: 1 in the first two tiers, else the share of the best score among them."""
    first = top(with_priority(fused), most, "priority", F.col("rrf").desc(), "id")
    best = F.greatest(F.max("rrf").over(Window.partitionBy()), F.lit(1e-12))  # a bounded list
    return first.withColumn("relevance", F.when(F.col("priority") < 2, 1.0).otherwise(F.col("rrf") / best))


def retrieval_metrics(ranking: DataFrame, required: DataFrame, group: str, k: int) -> DataFrame:
    """Per group: recall_at_k and mrr of a ranking (group, id, rank) against required (group, id)."""
    hit = required.join(ranking, [group, "id"], "left")
    best = hit.groupBy(group).agg(F.count("*").alias("n_required"), F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")).alias("recall_at_k"), F.min("rank").alias("best"))
    return best.select(group, "n_required", "recall_at_k", F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)).alias("mrr"))


def required_recall(required: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n_required, n_found and recall of the required ids; recall is 1 where nothing is required."""
    hits = required.join(found.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    out = hits.agg(F.count("*").alias("n_required"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", F.when(F.col("n_required") > 0, F.col("n_found") / F.col("n_required")).otherwise(1.0))


def evidence_similarity(a: str, b: str) -> Column:
    """How much two units say the same: structs a and b with id, memory_ids, blob, first, last (bytes), symbols, terms, events, path."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    same = (x("id") == y("id")) | ((F.size(x("memory_ids")) > 0) & (F.array_sort(F.array_distinct(x("memory_ids"))) == F.array_sort(F.array_distinct(y("memory_ids")))))
    shorter = F.greatest(F.lit(1), F.least(x("last") - x("first"), y("last") - y("first")))
    overlap = F.greatest(F.lit(0), F.least(x("last"), y("last")) - F.greatest(x("first"), y("first"))) / shorter
    parts = [F.when(x("blob") == y("blob"), overlap), 0.9 * jaccard(x("symbols"), y("symbols")), 0.7 * jaccard(x("terms"), y("terms")), 0.3 * jaccard(x("events"), y("events")), F.when(x("path") == y("path"), 0.15)]
    return F.when(same, 1.0).otherwise(F.greatest(*[F.coalesce(p, F.lit(0.0)) for p in parts]))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def similar_pairs(docs: DataFrame, id_: str, terms: str, least: float) -> DataFrame:
    """(a, b, similarity) of documents with Jaccard >= least, from a prefix-filtered join.

    Terms are ordered by rarity; a pair that is similar enough shares one of
    the first |x| - ceil(least * |x|) + 1 terms of both.  Products are rounded
    down by EDGE first, as 0.28 * 25 is a little more than 7 in floating point.
    """
    rows = docs.select(F.col(id_).alias("id"), F.array_distinct(F.col(terms)).alias("t")).where(F.size("t") > 0)
    df = rows.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ordered = rows.select("id", F.explode("t").alias("term")).join(df, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term")))["term"].alias("t"))
    ordered = cut(ordered)
    first = F.size("t") - F.ceil(F.lit(least) * F.size("t") - EDGE).cast("int") + 1
    prefix = ordered.select("id", F.size("t").alias("n"), F.posexplode(F.slice("t", F.lit(1), first)).alias("i", "term"))
    a, b = (prefix.select("term", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}")) for x in "ab")
    na, nb = F.col("na"), F.col("nb")
    alike = (na >= least * nb - EDGE) & (nb >= least * na - EDGE)
    # no more can be shared than stands from here on in either
    enough = F.least(na - F.col("ia"), nb - F.col("ib")) >= least / (1 + least) * (na + nb) - EDGE
    pairs = a.hint("merge").join(b, "term").where((F.col("a") < F.col("b")) & alike & enough).select("a", "b").distinct()
    for x in "ab":
        pairs = pairs.hint("merge").join(ordered.select(F.col("id").alias(x), F.col("t").alias(f"t{x}")), x)
    return pairs.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= least - EDGE)
