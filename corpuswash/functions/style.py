"""Advisory writing-style lint as Column expressions.  It reports and never rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswash.schema import bind, finding, none

#: Words and phrases that the lint counts (fixed values).
WORDS = [
    "delve", "boasts", "bolstered", "crucial", "underscore", "underscores", "garner", "garnered", "intricate", "intricacies", "meticulous",
    "meticulously", "tapestry", "testament", "vibrant", "showcase", "showcasing", "foster", "fostering", "pivotal", "leverage", "leveraging",
    "utilize", "utilizing", "harness", "harnessing", "streamline", "streamlining", "encompass", "encompassing", "exemplify", "exemplifies",
    "groundbreaking", "unwavering", "multifaceted", "landscape", "realm", "synergy", "underpinnings", "cutting-edge", "seamless", "indelible",
]
PHRASES = [
    "it's important to note", "it is important to note", "in today's fast-paced world", "in the ever-evolving", "when it comes to",
    "stands as a testament", "serves as a testament", "plays a pivotal role", "not only does", "not just a",
]
MIN_SENTENCES, MIN_MEAN_WORDS, LOW_VARIATION = 6, 3.0, 0.35
MIN_WORDS, DASHES_PER_1000 = 100, 4.0
CAVEAT = "Style findings are hints only: many people write this way, and no finding proves how a text was made."


def _substrings(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def word_counts(text: Column) -> Column:
    """(word, count) for the listed words that occur, in list order; one pass over the text for all of them."""
    plain = [w for w in WORDS if "-" not in w]
    listed = F.array(*[F.lit(w) for w in WORDS])

    def counts(b: Column) -> Column:
        low, hits = b["low"], b["hits"]
        inside = ((F.length(low) - F.length(F.replace(low, F.lit("cutting-edge"), F.lit("")))) / len("cutting-edge")).cast("bigint")
        count = lambda w: F.when(w == "cutting-edge", inside).otherwise(F.size(F.filter(hits, lambda t: t == w)).cast("bigint"))
        return F.filter(F.transform(listed, lambda w: F.struct(w.alias("label"), count(w).alias("count"))), lambda s: s["count"] > 0)

    low = F.lower(text)
    hits = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: t.isin(plain))
    return bind(F.struct(low.alias("low"), hits.alias("hits")), counts)


def phrase_counts(text: Column) -> Column:
    counts = lambda low: F.array(*[F.struct(F.lit(p).alias("label"), _substrings(low, p).alias("count")) for p in PHRASES])
    return F.filter(bind(F.lower(text), counts), lambda s: s["count"] > 0)


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has any; sentences end after each full stop, exclamation or question mark."""
    sentences = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0))
    return F.filter(F.transform(sentences, lambda s: F.regexp_count(s, F.lit(r"(?U)\S+"))), lambda n: n > 0)


def variation(text: Column) -> Column:
    """Coefficient of variation of the sentence lengths; null where there are too few or too short ones."""

    def of(lengths: Column) -> Column:
        n = F.size(lengths)
        total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)

        def spread(mean: Column) -> Column:
            squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
            return F.when((n >= MIN_SENTENCES) & (mean >= MIN_MEAN_WORDS), F.sqrt(squares / n) / mean)

        return bind(F.when(n >= MIN_SENTENCES, total / n), spread)  # a text without words has no mean

    return bind(sentence_lengths(text), of)


def dash_rate(text: Column) -> Column:
    """Em dashes per 1000 words; null below MIN_WORDS words."""
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    return F.when(words >= MIN_WORDS, F.regexp_count(text, F.lit("\u2014")) / words * 1000)


def inspect_style(text: Column) -> Column:
    times = lambda s: F.concat(F.lit("\u00d7"), s["count"].cast("string"))
    words = F.transform(word_counts(text), lambda s: finding("style", category=F.lit("vocabulary"), label=s["label"], value=times(s), count=s["count"]))
    phrases = F.transform(phrase_counts(text), lambda s: finding("style", category=F.lit("phrase"), label=s["label"], value=times(s), count=s["count"]))
    cv, rate = variation(text), dash_rate(text)
    n = F.size(sentence_lengths(text))
    uniform = finding("style", category=F.lit("statistic"), label=F.lit("uniform sentence length"), value=F.format_string("coefficient of variation %.2f across %d sentences", cv, n), count=n)
    dashes = finding("style", category=F.lit("statistic"), label=F.lit("elevated em dash usage"), value=F.format_string("%.1f per 1000 words", rate))
    found = F.concat(
        words,
        phrases,
        F.when(cv < LOW_VARIATION, F.array(uniform)).otherwise(none()),
        F.when(rate >= DASHES_PER_1000, F.array(dashes)).otherwise(none()),
    )
    return F.coalesce(F.transform(found, lambda f, i: f.withField("ordinal", i)), none())
