"""Text vectors: tokens, document frequencies, TF-IDF weights, cosines. Terms are counted natively, within their document's row."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.config import TEXT_STOP_WORDS, EngineConfig


def tokens(text: Column) -> Column:
    """Lower case, letters and digits, over two characters, no stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TEXT_STOP_WORDS))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often a lambda inside refers to it."""
    return F.transform(F.array(value), use)[0]


def _counted(tokens: Column) -> Column:
    """The distinct tokens of a row in their order and how often each occurs, without leaving the row; the row has at least one token."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        counts = lambda at: F.transform(at, lambda p, k: F.coalesce(F.get(at, k + 1), F.size(s)) - p)
        return _held(starts, lambda at: F.struct(F.transform(at, lambda p: F.get(s, p)).alias("terms"), counts(at).alias("tf")))

    return _held(F.sort_array(tokens), runs)


def bags(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tokens. doc_id, n (its tokens) and bag: its distinct terms and their counts, two arrays.

    Rows are counted where they are. Only rows that share an id are shuffled: those of one length are one bag. Rows without tokens have none.
    """
    full = docs.where(F.size("tokens") > 0)
    one = lambda df: df.select("doc_id", F.size("tokens").alias("n"), _counted(F.col("tokens")).alias("bag"))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc_id").alias("again"))
    if repeated.isEmpty():
        return one(full)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    rows = full.join(repeated, same, "left_semi").select("doc_id", F.size("tokens").alias("n"), F.explode("tokens").alias("term")).groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    met = rows.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf")))).alias("b"))
    return one(full.join(repeated, same, "left_anti")).unionByName(met.select("doc_id", "n", F.struct(F.col("b.term").alias("terms"), F.col("b.tf").alias("tf")).alias("bag")))


def term_frequency(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tokens. The tokens of a document are counted with its number of tokens beside them."""
    return bags(docs).select("doc_id", "n", F.inline(F.arrays_zip("bag.terms", "bag.tf")).alias("term", "tf")).withColumn("tf", F.col("tf").cast("long"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """A document's repeats go before the explode, so that one shuffle counts."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n_docs: int | Column) -> Column:
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((1 + n).cast("double") / (1 + df).cast("double")) + 1.0


#: Terms that at least this share of the documents hold are looked up where the document is, up to MAX_FREQUENT of them; the rest meet their frequency by join.
FREQUENT, MAX_FREQUENT = 8e-5, 400_000


def frequent_terms(df: DataFrame, n_docs: int) -> tuple[int, pa.Table]:
    """The least frequency that is looked up, and the terms that have it. It is raised until they are few, so the list does not grow with the table."""
    least = max(2, int(n_docs * FREQUENT))
    while (listed := df.where(F.col("df") >= least).limit(MAX_FREQUENT + 1).toArrow()).num_rows > MAX_FREQUENT:
        least *= 2
    return least, listed


def weights(docs: DataFrame, n_docs: int | None = None) -> DataFrame:
    """doc_id, n, n_docs and entries: an array of (term, tf, df, weight).

    A document's frequent terms come in one row, where they were counted; each of the others comes in a row of its own. So only rare terms
    are rows of a shuffle, and a frequent one is no key of a join.
    """
    n_docs = docs.count() if n_docs is None else n_docs
    frequencies = document_frequency(docs)
    least, listed = frequent_terms(frequencies, n_docs)
    vocabulary, known_df = listed.column("term").combine_chunks(), listed.column("df").combine_chunks()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            bag = batch.column("bag")
            terms, tf = bag.field("terms"), bag.field("tf")
            found = pc.fill_null(known_df.take(pc.index_in(terms.flatten(), value_set=vocabulary)), 0)
            lists = [pa.ListArray.from_arrays(terms.offsets, x) for x in (terms.values, tf.values, found)] if terms.offset == 0 and len(terms.values) == len(found) == len(tf.values) else None
            if lists is None:  # a slice of a longer batch: offsets anew
                offsets = pa.array([0, *pc.cumulative_sum(pc.list_value_length(terms)).to_pylist()], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (terms.flatten(), tf.flatten(), found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), *lists], names=["doc_id", "n", "terms", "tf", "df"])

    kind = dict(docs.dtypes)["doc_id"]
    told = bags(docs).mapInArrow(look_up, f"doc_id {kind}, n int, terms array<string>, tf array<int>, df array<long>")
    entry = lambda term, tf, df: F.struct(term.alias("term"), tf.cast("long").alias("tf"), df.alias("df"), ((tf.cast("double") / F.col("n").cast("double")) * idf(df, n_docs)).alias("weight"))
    all_terms = F.arrays_zip("terms", "tf", "df")
    known = told.select("doc_id", "n", F.lit(n_docs).cast("long").alias("n_docs"), F.transform(F.filter(all_terms, lambda x: x["df"] > 0), lambda x: entry(x["terms"], x["tf"], x["df"])).alias("entries"))
    rare = told.select("doc_id", "n", F.inline(F.filter(all_terms, lambda x: x["df"] == 0)).alias("term", "tf", "no_df")).drop("no_df")
    met = rare.join(frequencies.where(F.col("df") < least), "term")
    return known.unionByName(met.select("doc_id", "n", F.lit(n_docs).cast("long").alias("n_docs"), F.array(entry(F.col("term"), F.col("tf"), F.col("df"))).alias("entries")))


def top_terms(weighted: DataFrame, k: int = 8) -> DataFrame:
    """Each row gives its own k best at most, so that few terms of a document are shuffled."""
    ranked = F.sort_array(F.transform("entries", lambda x: F.struct((-F.round(x["weight"], 12)).alias("least"), x["term"].alias("term"), x["tf"].alias("tf"), x["df"].alias("df"), x["weight"].alias("weight"))))
    own = weighted.select("doc_id", F.inline(F.slice(ranked, 1, k))).drop("least")
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 12)), "term")
    return own.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def vectors(weighted: DataFrame) -> DataFrame:
    """A row a document: parts of its vector, each of so many tokens, the terms as a string without the weights, which follow from the rest."""
    part = F.struct("n", "n_docs", F.array_join("entries.term", " ").alias("terms"), F.transform("entries.tf", lambda x: x.cast("int")).alias("tf"), F.col("entries.df").alias("df"))
    return weighted.where("doc_id is not null and size(entries) > 0").select("doc_id", part.alias("part")).groupBy("doc_id").agg(F.collect_list("part").alias("parts"))


def unpacked(parts: Column) -> Column:
    """The vector whose parts these are: an array of (term, w)."""
    entry = lambda p: lambda x: F.struct(x["0"].alias("term"), ((x["tf"].cast("double") / p["n"].cast("double")) * idf(x["df"], p["n_docs"])).alias("w"))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.arrays_zip(F.split(p["terms"], " "), p["tf"], p["df"]), entry(p))))


def dot(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the dot product of two vectors of a row: sorted together, a term that both have stands twice in a row."""
    met = df.withColumn("_both", F.sort_array(F.concat(a, b)))
    pairs = F.transform("_both", lambda x, i: F.when(x["term"] == F.get("_both", i + 1)["term"], x["w"] * F.get("_both", i + 1)["w"]).otherwise(0.0))
    return met.withColumn(name, F.aggregate(F.coalesce(pairs, F.array()), F.lit(0.0), lambda t, x: t + x)).drop("_both")


def cosine(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """pairs: (a, b) of documents. 0 where they share no term, 1 at most. Vectors meet by document, so no term is a key of a join."""
    made = vectors(weighted)
    side = lambda x: made.select(F.col("doc_id").alias(x), F.col("parts").alias(f"p{x}"))
    wide = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({"va": unpacked(F.col("pa")), "vb": unpacked(F.col("pb"))}).drop("pa", "pb")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x["w"] * x["w"]))
    met = dot(wide, "va", "vb", "dot").withColumns({"na": norm("va"), "nb": norm("vb")})
    value = F.when(F.coalesce(F.col("dot"), F.lit(0.0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("dot") / (F.col("na") * F.col("nb"))))
    return met.select("a", "b", value.alias("cosine"))


def _pool_cosines(source: object, pool: int, members: list[dict]) -> Iterator[tuple[object, float]]:
    """Cosine of a source with each of its targets, by frequencies within the pool."""
    df, held = Counter(), {}
    for m in members:
        df.update(m["terms"])
        held.setdefault(m["doc_id"], {})[m["n"], m["mark"]] = m
    inverse = {d: math.log((1 + pool) / (1 + d)) + 1.0 for d in set(df.values())}

    def vector(rows: dict) -> tuple[dict[str, float], float]:
        counts: dict[int, Counter] = {}
        for (n, _), m in rows.items():
            counts.setdefault(n, Counter()).update(dict(zip(m["terms"], m["tf"], strict=True)))
        weights, squares = {}, 0.0
        for n, tf in counts.items():
            for term, c in tf.items():
                w = c / n * inverse[df[term]]
                weights[term] = weights.get(term, 0.0) + w
                squares += w * w
        return weights, math.sqrt(squares)

    if source not in held:
        return
    own, norm = vector(held.pop(source))
    for target, rows in held.items():
        other, length = vector(rows)
        dot = sum(w * own[t] for t, w in other.items() if t in own)
        if dot:
            yield target, min(1.0, dot / (norm * length))


def batch_scores(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs: (source, target). Cosines with frequencies counted over each source and its targets, a target once for each pair.

    A source's documents meet in one row as bags of words, so one task holds the pool of one source at a time. No single term is shuffled.
    """
    members = pairs.select("source", F.col("target").alias("doc_id")).unionByName(pairs.select("source", F.col("source").alias("doc_id")).distinct()).where("source is not null")
    sized = members.join(members.groupBy("source").agg(F.count("*").alias("pool")), "source")
    marked = docs.where("doc_id is not null and size(tokens) > 0").select("doc_id", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("mark"), _counted(F.col("tokens")).alias("bag"))
    # Words have no spaces: a string of them is shuffled in fewer bytes than an array.
    packed = marked.select("doc_id", "n", "mark", F.array_join("bag.terms", " ").alias("terms"), F.col("bag.tf").alias("tf"))
    met = sized.join(packed, "doc_id").groupBy("source").agg(F.max("pool").alias("pool"), F.collect_list(F.struct("doc_id", "n", "mark", "terms", "tf")).alias("members"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, pool, members in zip(*(batch.column(c) for c in ("source", "pool", "members")), strict=True):
                rows = [m | {"terms": m["terms"].split(" ")} for m in members.as_py()]
                key = source.as_py()
                out += [(key, t, c) for t, c in _pool_cosines(key, pool.as_py(), rows)]
            kind = batch.schema.field("source").type
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.float64())], names=["source", "target", "cosine"])

    kind = dict(pairs.dtypes)["source"]
    found = met.mapInArrow(score, f"source {kind}, target {kind}, cosine double")
    return pairs.join(found, ["source", "target"], "left").select("source", "target", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def word_count(text: Column) -> Column:
    """Runs of ASCII letters, hyphens and apostrophes."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z'-]*)"), F.lit(1)))


def heuristic_relevance(keyword: Column, title: Column, age_days: Column, same_category: Column) -> Column:
    exact = F.translate(F.trim(keyword), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == F.translate(F.trim(title), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fresh = F.when(age_days < 30, 1.2).when(age_days < 90, 1.1).otherwise(1.0)
    return F.round(F.when(exact, 1.5).otherwise(1.0) * (1.0 + 0.1 * word_count(keyword)) * fresh * F.when(same_category, 1.3).otherwise(1.0), 2)


def blended_relevance(cosine_col: Column, best: Column, heuristic: Column) -> Column:
    """Cosine over the best of the source's, and the heuristic; 0 to 100."""
    lexical = F.when(best > 0, cosine_col / best).otherwise(0.0)
    return F.round(100.0 * (0.7 * lexical + 0.3 * F.least(F.lit(1.0), heuristic / 5.0)), 1)


def top_k(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key; Spark keeps k a key before it shuffles."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def target_pool(sources: DataFrame, targets: DataFrame, excluded: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The newest targets of each source, without itself and the excluded.

    sources: source; targets: target, age_days; excluded: source, target. Every source meets the newest k + 1 targets. Only sources that lose
    more than one of them to exclusions meet a list of twice the length, and so on, so that a source with very many exclusions makes nobody
    else meet more targets. The list is one row, filtered inside each source's row: pairs are neither shuffled nor ranked by a window.
    """
    k, size, n_targets = cfg.targets_per_source, cfg.targets_per_source + 1, None
    todo, found = sources, []
    while True:
        newest = targets.orderBy("age_days", F.desc("target")).limit(size)
        entries = F.sort_array(F.collect_list(F.struct("age_days", (-F.col("target")).alias("back"), "target")))
        listed = newest.agg(F.transform(entries, lambda x: x["target"]).alias("listed"))  # one row
        lost = excluded.join(newest.select("target"), "target", "left_semi").groupBy("source").agg(F.collect_set("target").alias("lost"))
        left = F.filter("listed", lambda t: (t != F.col("source")) & ~F.coalesce(F.array_contains("lost", t), F.lit(False)))
        held = todo.join(lost, "source", "left").join(F.broadcast(listed)).select("source", F.slice(left, 1, k).alias("pool"))
        full = held if n_targets is not None and size >= n_targets else held.where(F.size("pool") == k)
        found.append(full.select("source", F.posexplode("pool").alias("rank", "target")).select("source", "target", (F.col("rank") + 1).alias("rank")))
        if full is held:
            return reduce(DataFrame.unionByName, found)
        todo = held.where(F.size("pool") < k).select("source")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)
        n_targets = targets.count() if n_targets is None else n_targets
        size *= 2
