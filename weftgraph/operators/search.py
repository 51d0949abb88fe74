"""Symbol lookup and lexical matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.substrings import contained
from weftgraph.session import materialize

MIN_WORD_BYTES = 3
SEED_COUNT = 5
#: Words that a class of nodes may list.
CLASS_WORDS = 16


class SymbolNotFound(LookupError):
    pass


class AmbiguousSymbol(LookupError):
    pass


def symbol_candidates(nodes: DataFrame, query: str) -> DataFrame:
    """All nodes of the best tier that matches: (id, tier).

    Tier 1 is the id, 2 the exact name, 3 a case-insensitive part of the name.
    Only the best tier's number is looked up first; no window over all matches.
    """
    tier = (
        F.when(F.col("id") == query, 1)
        .when(F.col("name") == query, 2)
        .when(F.contains(F.lower("name"), F.lit(query.lower())), 3)
    )
    matches = nodes.select("id", tier.alias("tier")).filter("tier IS NOT NULL")
    best = matches.agg(F.min("tier").alias("tier"))
    return matches.join(F.broadcast(best), "tier", "left_semi").select("id", "tier")


def find_symbol(nodes: DataFrame, query: str) -> str:
    """The id of the one node that ``query`` names, or an error listing the others.

    An id is looked for first: that filter reaches the scan, names need all of it.
    """
    if not nodes.filter(F.col("id") == query).isEmpty():
        return query
    hits = symbol_candidates(nodes, query)
    first = [r["id"] for r in hits.select("id").take(2)]
    if not first:
        raise SymbolNotFound(f"no symbol found matching {query!r}")
    if len(first) > 1:
        every = (r["id"] for r in hits.select("id").orderBy("id").toLocalIterator())
        raise AmbiguousSymbol(f"ambiguous symbol {query!r}, matches: {', '.join(every)}")
    return first[0]


def question_words(question: str) -> list[str]:
    """Lower-cased words of at least three bytes, repeats kept, punctuation kept."""
    return [w for w in question.lower().split() if len(w.encode()) >= MIN_WORD_BYTES]


def lexical_scores(nodes: DataFrame, question: str) -> DataFrame:
    """(id, score): one point per question word that contains the name or is in it.

    The words are literals of the query, so scoring is a map over the nodes.
    """
    words = question_words(question)
    if not words:
        return nodes.select("id", F.lit(0).alias("score")).filter(F.lit(False))
    name = F.lower("name")
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w) | F.contains(w, name))
    return nodes.select("id", F.size(hits).alias("score")).filter("score > 0")


def _asked(questions: DataFrame) -> DataFrame:
    """(question_id, word, times) of questions (question_id, question), stored once."""
    words = F.filter(F.split(F.lower("question"), r"\s+"), lambda w: F.octet_length(w) >= MIN_WORD_BYTES)
    return materialize(
        questions.select("question_id", F.explode(words).alias("word")).groupBy("question_id", "word").agg(F.count(F.lit(1)).alias("times")), "question-words"
    )


def _word_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name) of which one is in the other, stored once."""
    inside = contained(words, names).toDF("word", "name")
    around = contained(names, words).toDF("name", "word").select("word", "name")
    return materialize(inside.union(around).distinct(), "word-names")


def lexical_scores_of_each(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, id, score) of many questions (question_id, question) at once; the score is that of one question.

    Which words and names contain one another is found once per different word and
    name, by an index of their n-grams in either direction.
    """
    asked = _asked(questions)
    named = materialize(nodes.select("id", F.lower("name").alias("name")).where("name IS NOT NULL"), "names")
    pairs = _word_names(asked.select("word"), named.select("name"))
    # A word that is in many names, or a name with many nodes, is split by adaptive execution.
    hits = asked.join(pairs, "word").groupBy("question_id", "name").agg(F.sum("times").alias("score"))
    return hits.join(named, "name").groupBy("question_id", "id").agg(F.sum("score").cast("int").alias("score"))


def lexical_match_of_each(nodes: DataFrame, questions: DataFrame, limit: int = SEED_COUNT) -> DataFrame:
    """The best-scoring ids of each question, ties by id.

    Nodes that meet the same words have the same score in every question, so only
    the ``limit`` first ids of such a class can be among the best.  Questions are
    paired with classes; a name's nodes are never paired with questions.
    """
    asked = _asked(questions)
    owned = nodes.where("name IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list(F.lower("name"))).alias("names"))
    named = materialize(_first_ids(owned, "names", limit), "names")
    pairs = _word_names(asked.select("word"), named.select(F.explode("names")))
    each = named.select("names").distinct().select("names", F.explode("names").alias("name"))
    met = materialize(each.join(pairs, "name").groupBy("names", "word").agg(F.count(F.lit(1)).alias("n")), "names-words")
    # Names with many words are classes of their own, so that no class has a long list of words.
    few = met.groupBy("names").agg(F.count(F.lit(1)).alias("_words")).where(F.col("_words") <= CLASS_WORDS).select("names")
    sets = met.join(few, "names").groupBy("names").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("words"))
    own = F.struct(F.when(F.col("words").isNull(), F.col("names")).alias("names"), "words")
    classed = materialize(met.select("names").distinct().join(sets, "names", "left").select("names", own.alias("class")), "classes")
    ids = materialize(_first_ids(named.join(classed, "names").select("class", "id"), "class", limit), "class-ids")
    short = classed.where("class.words IS NOT NULL").select("class").distinct().select("class", F.inline("class.words"))
    long = met.join(classed.where("class.words IS NULL"), "names").select("class", "word", "n")
    hits = asked.join(short.unionByName(long), "word").groupBy("question_id", "class").agg(F.sum(F.col("times") * F.col("n")).alias("score"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    ranked = hits.join(ids, "class").select("question_id", "id", F.col("score").cast("int").alias("score")).withColumn("place", F.row_number().over(best))
    return ranked.where(F.col("place") <= limit)


def _first_ids(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` first ids of every ``key``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).select(key, "id")


def lexical_match(nodes: DataFrame, question: str, limit: int = SEED_COUNT) -> DataFrame:
    """The best-scoring ids, ties by id."""
    return lexical_scores(nodes, question).orderBy(F.desc("score"), "id").limit(limit)
