"""Text features and template functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in order of precedence.
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which", "whose")
#: Words looked for as substrings, each at most once a text.
UNCERTAIN = ("might", "may", "perhaps", "possibly", "allegedly", "reportedly", "supposedly", "apparently")
ACADEMIC = ("theorem", "prove", "discovery", "theory", "formula", "principle", "law", "equation")
FICTION = ("wrote", "book", "novel", "story", "character", "author")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def text_features(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts, diversity, question word, ratios and lexicon hits; empty texts give zeros."""
    c = F.coalesce(F.col(text), F.lit(""))
    t = tokens(c)
    n, chars = F.size(t), F.length(c)
    low = F.lower(c)
    qw = F.lit(None).cast("string")
    for w in reversed(QUESTION_WORDS):
        qw = F.when(low.contains(w), w).otherwise(qw)
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    capitals, marks = F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(c, r"""[^.,!?;:()"']""", ""))
    numbers = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return df.select(
        key, n.alias("n_tokens"), chars.alias("n_chars"), F.size(F.array_distinct(t)).alias("n_unique"), z(F.size(F.array_distinct(t)), n).alias("lexical_diversity"),
        z(F.aggregate(t, F.lit(0), lambda s, x: s + F.length(x)), n).alias("avg_word_len"), qw.alias("question_word"),
        capitals.alias("n_capitals"), z(capitals, chars).alias("capital_ratio"), marks.alias("n_punct"), z(marks, chars).alias("punct_ratio"),
        (F.size(numbers) > 0).cast("int").alias("has_numbers"), F.size(numbers).alias("n_numbers"),
        *[sum((low.contains(h).cast("int") for h in words), F.lit(0)).alias(name) for name, words in (("n_uncertain", UNCERTAIN), ("n_academic", ACADEMIC), ("n_fiction", FICTION))],
    )


def trigram_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Entropy in bits of the character trigrams, case kept; texts under three characters have 0."""
    c = F.coalesce(F.col(text), F.lit(""))
    g = df.select(key, F.explode_outer(F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))).alias("g"))
    n = g.groupBy(key, "g").agg(F.count("g").alias("n"))
    return n.groupBy(key).agg(F.coalesce(F.log2(F.sum("n")) - F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n"))) / F.sum("n"), F.lit(0.0)).alias("entropy"))


def fill(template: Column, values: Column) -> Column:
    """``{name}`` replaced from a map; names without a value become ``[name]``."""
    filled = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(F.coalesce(filled, template), r"\{(\w+)\}", "[$1]")


def has_placeholder(c: Column) -> Column:
    return c.rlike(r"\[[a-z_0-9]+\]")


def numbered_lines(c: Column, most: int = 3) -> Column:
    """Texts of the first lines of the form "1. text"."""
    return F.slice(F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*\d+[.)]\s*(\S.*)$"), F.lit(1)), lambda x: F.trim(x)), 1, most)


def chat_messages(question: Column, answer: Column) -> Column:
    """User and assistant messages; null if either side is blank."""
    m = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.when((F.trim(question) != "") & (F.trim(answer) != ""), F.array(m("user", question), m("assistant", answer)))


def ground_truth_text(best: Column, also: Column, wrong: Column) -> Column:
    """Best answer, other accepted answers and known wrong ones in one text; absent parts are left out."""
    part = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(xs, "; ")))
    return F.concat_ws("\n", F.concat(F.lit("Best answer: "), best), part("Also acceptable: ", also), part("Known incorrect: ", wrong))


def token_estimate(c: Column) -> Column:
    return F.length(c) / 4


def perturb(question: Column, method: Column, u: Column) -> Column:
    """Perturbed question by method: context, synonym (first match only), noise, nonsense suffix, false premise. ``u`` in [0, 1) picks."""
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.floor(u * len(xs)).cast("int"))
    syn = question
    for a, b in reversed((("how many", "what number of"), ("who", "which person"), ("first", "earliest"), ("when", "at what time"))):
        syn = F.when(F.lower(question).contains(a), F.regexp_replace(question, f"(?i)^(.*?){a}", f"$1{b}")).otherwise(syn)
    return (
        F.when(method == "confusing", F.concat(question, F.lit(" "), pick(("Bear in mind that sources differ.", "Note that the record was revised."))))
        .when(method == "synonyms", syn).when(method == "noise", F.concat(pick(("By the way, ", "Generally speaking, ")), question))
        .when(method == "nonsense", F.concat(question, F.lit(" <"), F.substring(F.md5(question.cast("binary")), 1, 12), F.lit(">")))
        .when(method == "false_premise", F.concat(pick(("Assume the opposite. ", "Suppose this is untrue. ")), question)).otherwise(question)
    )


def ground_truth_rule(category: Column, question: Column, values: Column) -> Column:
    """Which rule states the ground truth of a prompt by its category, its words and what was filled in; the first that holds."""
    q = F.coalesce(question, F.lit(""))
    low = F.lower(q)
    has = lambda c, *ws: F.coalesce(F.greatest(*[F.contains(c, F.lit(w)) for w in ws], F.lit(False)), F.lit(False))
    endless = has(q, "last", "largest", "final")
    impossible = (
        F.when(F.coalesce(F.map_contains_key(values, "conjecture"), F.lit(False)) | has(q, "Hypothesis", "P = NP", "P != NP"), "open problem")
        .when(endless & has(q, "prime", "integer", "digit of pi"), "no such object").when(endless, F.lit(None))
        .when(has(q, "future", "predict"), "unknowable future").when(has(q, "exactly what I"), "unreadable thought").otherwise("unknowable")
    )
    factual = F.when(has(low, "president"), "office").when(has(low, "capital"), "capital").when(has(low, "chemical formula"), "formula").when(has(low, "who wrote"), "author").otherwise("verifiable")
    return F.coalesce(
        F.when(category == "impossible", impossible).when(category == "nonexistent", "invented").when(category == "ambiguous", "no single answer").when(category == "factual", factual), F.lit("not specified")
    )
