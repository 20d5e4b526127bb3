"""Grounding of text values in every document of a corpus.

Containment and fuzzy matching have no equi-key of their own, so each value gets a
few: pieces of tokens or whole tokens of which a matching document must have at
least one. Which tokens is decided by how rare they are in the corpus. A document
is read once, its keys are intersected with those asked for, and only the pairs
that share a key are checked exactly; nothing is lost and no pair is made twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import normalize_minimal, normalize_search
from groundline.operators.evidence import token_key, token_keys
from groundline.operators.fixed_matching import (
    fuzzy_eligible,
    fuzzy_possible,
    fuzzy_window,
    least_overlap,
)
from groundline.session import bytes_fit_broadcast, ensure_checkpoint_dir, fits_broadcast


def value_forms(values: DataFrame) -> DataFrame:
    """Values (``value_id, text``) with the forms they are looked up by; blank ones drop out."""
    text = F.col("text")
    forms = values.select(
        "value_id", normalize_minimal(text).alias("v_minimal"), normalize_search(text).alias("v_search")
    )
    return forms.filter(F.col("v_minimal") != "")


def document_forms(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    return documents.select(
        "doc_id", normalize_minimal(text).alias("src_minimal"), normalize_search(text).alias("src_search")
    )


def _tokens(search: Column) -> Column:
    return F.split(search, " ")


def _each(sources: DataFrame, items: Column, name: str, *others: str) -> DataFrame:
    """A row per item of a list made of a text; a join on the item drops those without one.

    Of a plain ``explode`` Spark infers a filter on the list, which would make it, and the forms of the text, again.
    """
    return sources.select(*others, F.explode_outer(items).alias(name))


def token_frequencies(forms: DataFrame, sources: DataFrame) -> DataFrame:
    """In how many documents each token of the values occurs."""
    wanted = forms.select(F.explode(_tokens(F.col("v_search"))).alias("token")).distinct()
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    seen = _each(sources, F.array_distinct(_tokens(F.col("src_search"))), "token")
    return seen.join(wanted, "token").groupBy("token").agg(F.count("*").alias("df"))


def value_keys(forms: DataFrame, frequencies: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The keys of each value: every document that matches it has at least one.

    * Three tokens or more: the rarest inner token, which containment keeps whole.
    * Fewer: a piece of the longest token.
    * Fuzzy: the rarest tokens, so many that a document without any of them would miss
      more occurrences than the threshold forgives (the prefix filter of set joins).
    """
    tokens = _tokens(F.col("v_search"))
    rows = forms.select(
        "value_id", "v_minimal", "v_search", F.size(tokens).alias("n"),
        (F.lit(fuzzy) & fuzzy_eligible(tokens)).alias("fuzzy"),
        (F.size(tokens) - least_overlap(tokens) + 1).alias("prefix"),
        F.posexplode(tokens).alias("pos", "token"),
    ).join(frequencies, "token", "left").na.fill(0, ["df"])
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1)
    per_token = rows.groupBy("value_id", "v_minimal", "v_search", "n", "fuzzy", "prefix", "token", "df").agg(
        F.count("*").alias("occurrences"), F.max(inner).alias("inner")
    )
    # A value that can match has at most a few thousand distinct tokens.
    by_rarity = Window.partitionBy("value_id").orderBy("df", "token")
    ranked = per_token.withColumn(
        "before", F.sum("occurrences").over(by_rarity) - F.col("occurrences")
    ).withColumn(
        "inner_rank", F.row_number().over(
            Window.partitionBy("value_id").orderBy(F.desc("inner"), "df", "token")
        )
    )
    rarest_inner = (F.col("n") >= 3) & (F.col("inner_rank") == 1) & F.col("inner")
    in_prefix = F.col("fuzzy") & (F.col("before") < F.col("prefix"))
    whole = ranked.filter(rarest_inner | in_prefix).select("value_id", "token")
    whole = whole.select("value_id", F.concat(F.lit("="), "token").alias("key"))
    short = forms.filter(F.size(tokens) < 3).select(
        "value_id", F.concat(F.lit("~"), token_key(F.col("v_search"), F.col("v_minimal"))).alias("key")
    )
    return whole.unionByName(short.filter(F.col("key").isNotNull())).distinct()


def _source_keys(pieces: bool) -> Column:
    keys = F.transform(F.array_distinct(_tokens(F.col("src_search"))), lambda t: F.concat(F.lit("="), t))
    if not pieces:
        return keys
    cut = F.array_distinct(token_keys(F.col("src_search"), F.col("src_minimal")))
    return F.concat(keys, F.transform(cut, lambda t: F.concat(F.lit("~"), t)))


def candidate_pairs(forms: DataFrame, keys: DataFrame, sources: DataFrame) -> DataFrame:
    """Value and document pairs that share a key, each once, with their forms.

    While the keys and forms of the values fit a broadcast, in rows and in bytes, the documents
    are not shuffled at all: a pair is kept at the first of the value's keys that the document
    has. Beyond that size the keys of the documents are shuffled without their text, and the
    text is joined to the pairs found. Keys that many documents have spread over the documents
    in the first way; in the second the adaptive join splits them. A value of one or two signs
    meets every document that holds them: such pairs are results, and cost as much.
    """
    pieces = not keys.filter(F.col("key").startswith("~")).isEmpty()
    listed = keys.groupBy("value_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    asked = forms.join(listed, "value_id").withColumn("key", F.explode("keys"))
    carried = F.length("v_minimal") + F.length("v_search") + F.length(F.array_join("keys", " "))
    if fits_broadcast(keys) and bytes_fit_broadcast(asked, carried):
        held = sources.withColumn("held", _source_keys(pieces))
        met = _each(held, F.col("held"), "key", *held.columns).join(F.broadcast(asked), "key")
        first = F.when(F.size("keys") == 1, F.col("key")).otherwise(F.array_min(F.array_intersect("keys", "held")))
        return met.filter(F.col("key") == first).drop("key", "keys", "held")
    posted = _each(sources, _source_keys(pieces), "key", "doc_id")
    pairs = posted.join(keys, "key").select("doc_id", "value_id").distinct()
    return pairs.join(forms, "value_id").join(sources, "doc_id")


def ground_in_corpus(values: DataFrame, documents: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Every match of a value in a document: exact, normalized or fuzzy."""
    forms, sources = value_forms(values), document_forms(documents)
    # The keys take a pass over the corpus and are asked for several times, so they are kept.
    ensure_checkpoint_dir(values.sparkSession)
    keys = value_keys(forms, token_frequencies(forms, sources), fuzzy).checkpoint()
    pairs = candidate_pairs(forms, keys, sources)
    tokens = _tokens(F.col("v_search"))
    rung = (
        F.when(F.col("src_minimal").contains(F.col("v_minimal")), "exact")
        .when((F.col("v_search") != "") & F.col("src_search").contains(F.col("v_search")), "normalized")
    )
    if fuzzy:
        possible = fuzzy_eligible(tokens) & fuzzy_possible(tokens, _tokens(F.col("src_search")))
        rung = rung.when(possible, "possible")
    found = pairs.select("value_id", "doc_id", "v_search", "src_search", rung.alias("match_type"))
    found = found.filter(F.col("match_type").isNotNull())
    if not fuzzy:
        return found.select("value_id", "doc_id", "match_type")
    asked = F.col("match_type") == "possible"
    hit = fuzzy_window(F.when(asked, F.col("v_search")), F.when(asked, F.col("src_search")))
    settled = found.withColumn("hit", hit).filter(~asked | F.col("hit"))
    return settled.select(
        "value_id", "doc_id", F.when(asked, "fuzzy").otherwise(F.col("match_type")).alias("match_type")
    )
