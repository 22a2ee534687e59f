"""URL verdicts: host and path rules first, then naive Bayes over segmented names.

The rules' own verdicts are the labels that the classifier learns from, and
the words of all pages are the dictionary of the segmenter. Nothing but a few
totals reaches the driver: dictionary, names and word weights are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text import LOWER, UPPER
from sparkloom.operators.joins import lookup
from sparkloom.staging import BROADCAST_BYTES, materialize

#: An unknown word of n letters is as likely as UNKNOWN_COUNT / 10**n occurrences among all words.
UNKNOWN_COUNT = 10.0
#: Of a word and its count in a worker's dictionary, about.
WORD_BYTES = 64
#: Added to the count of every word in every class.
SMOOTHING = 1.0
_MARKUP = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if there is no url or no ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.char_length(u))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (text, verdict) that fits, or null.

    A rule "host/path" fits its host and all subdomains, if the path starts
    with the rule's. Of rules of one length the first in the list wins.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(does)).otherwise(verdict)
    return text, verdict


def unruled_parts(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Host and path without the longest host suffix and the longest path prefix that any rule names.

    What the rules look at says nothing beyond the rules, so it is left out of
    all urls alike, whether a rule fits them or not.
    """
    bare_host, bare_path = host, path
    for name in sorted({rule.partition("/")[0] for _, rule in rules}, key=len):
        bare_host = F.when(host == name, F.lit("")).when(host.endswith("." + name), F.left(host, F.char_length(host) - len(name) - 1)).otherwise(bare_host)
    for start in sorted({"/" + rule.partition("/")[2] for _, rule in rules}, key=len):
        bare_path = F.when(path.startswith(start), path.substr(F.lit(len(start) + 1), F.char_length(path))).otherwise(bare_path)
    return bare_host, bare_path


def names_of(host: Column, path: Column) -> Column:
    """The runs of letters a-z in host and path, with repeats."""
    return F.regexp_extract_all(F.concat_ws(" ", host, F.translate(path, UPPER, LOWER)), F.lit("[a-z]+"), F.lit(0))


# --------------------------------------------------------------- segmentation


def page_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): every run of letters a-z in the visible text of all pages, lower-cased, and how often it occurs."""
    text = F.translate(F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), _MARKUP, " "), UPPER, LOWER)
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def likeliest_split(length: int, known: dict[tuple[int, int], float], total: float) -> list[int]:
    """Ends of the words of the likeliest split of a name of ``length`` letters (Viterbi search).

    ``known`` has the count of each known word by (start, letters); other
    stretches are unknown words. Of equally likely splits that with the
    longest last word wins.
    """
    log_total, per_letter = math.log(total), math.log(10)
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, letters), n in known.items():
        ending.setdefault(start + letters, []).append((start, log_total - math.log(n)))
    best, back = [0.0], [0]
    # an unknown word costs the same for every start but for its letters, so one start is the best for all ends to come
    fixed, cheapest = log_total - math.log(UNKNOWN_COUNT), (0.0, 0)
    for end in range(1, length + 1):
        choices = [(best[start] + cost, start) for start, cost in ending.get(end, ())]
        choices.append((cheapest[0] + fixed + per_letter * end, cheapest[1]))
        cost, start = min(choices)
        best.append(cost)
        back.append(start)
        cheapest = min(cheapest, (cost - per_letter * end, end))
    ends = [length] if length else []
    while ends and back[ends[-1]]:
        ends.append(back[ends[-1]])
    return ends[::-1]


def stretches(counts: dict[str, int]) -> dict[str, list[int]]:
    """The lengths of the known words that begin with the same (up to three) letters."""
    found: dict[str, set[int]] = {}
    for word in counts:
        found.setdefault(word[:3], set()).add(len(word))
    return {k: sorted(v) for k, v in found.items()}


def known_in(name: str, counts: dict[str, int], lengths: dict[str, list[int]]) -> dict[tuple[int, int], int]:
    """(start, letters) and count of the known words in a name, trying the lengths that words with its next letters have."""
    out = {}
    for start in range(len(name)):
        for first in (1, 2, 3):
            for letters in lengths.get(name[start : start + first], ()) if start + first <= len(name) else ():
                n = counts.get(name[start : start + letters]) if start + letters <= len(name) else None
                if n:
                    out[start, letters] = n
    return out


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words): each distinct name of ``names`` split into its likeliest words by the unigram counts ``words`` (a written table).

    A dictionary of few enough bytes is sent to the workers, which look up the
    stretches of a name there; a larger one is joined by shuffle. A name with
    no known word in it is one unknown word.
    """
    if words.count() * WORD_BYTES > BROADCAST_BYTES:
        return segment_by_join(names, words)
    counts = {r.word: r.n for r in words.collect()}
    sent, total = names.sparkSession.sparkContext.broadcast(counts), sum(counts.values()) or 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = sent.value, stretches(sent.value)
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                ends = likeliest_split(len(name), known_in(name, known, lengths), total)
                out.append([name[i:j] for i, j in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return names.select("name").mapInArrow(run, "name string, words array<string>")


def segment_by_join(names: DataFrame, words: DataFrame) -> DataFrame:
    """`segment` for a dictionary of any size: all stretches of a name that are no longer than the longest word are looked up by join."""
    total, longest = words.agg(F.coalesce(F.sum("n"), F.lit(1)), F.coalesce(F.max(F.length("word")), F.lit(1))).first()
    start = F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("start")
    letters = F.explode(F.sequence(F.lit(1), F.least(F.length("name") - F.col("start"), F.lit(longest)))).alias("letters")
    pieces = names.select("name", start).select("name", "start", letters)
    pieces = pieces.select("name", "start", "letters", F.col("name").substr(F.col("start") + 1, F.col("letters")).alias("word"))
    found = lookup(pieces, words, "word", row_bytes=64).groupBy("name").agg(F.collect_list("start").alias("start"), F.collect_list("letters").alias("letters"), F.collect_list("n").alias("n"))
    found = names.join(found, "name", "left").select("name", "start", "letters", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, starts, sizes, counts in zip(*(c.to_pylist() for c in b.columns)):
                ends = likeliest_split(len(name), dict(zip(zip(starts or (), sizes or ()), counts or ())), total)
                out.append([name[i:j] for i, j in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return found.mapInArrow(run, "name string, words array<string>")


# -------------------------------------------------------------- naive Bayes


def word_weights(labelled: DataFrame, split: DataFrame) -> tuple[DataFrame, float]:
    """(word, weight), log-odds of block against allow per occurrence, and those of a url without known words.

    ``labelled`` has one row per name and verdict with the number ``n`` of its
    occurrences, and for each verdict one row with a null name and the number
    of urls. A class without urls counts as one url without words.
    """
    blocked = F.col("verdict") == "block"
    sides = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("b", blocked), ("a", ~blocked))]
    urls = labelled.where("name IS NULL").agg(*sides).first()
    counts = labelled.where("name IS NOT NULL").groupBy("name").agg(*sides).join(split, "name").select(F.explode("words").alias("word"), "b", "a")
    counts = materialize(counts.groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "url-word-counts")
    b, a, kinds = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    rate = lambda c, n: F.log((F.col(c) + SMOOTHING) / (n + SMOOTHING * max(kinds, 1)))
    return counts.select("word", (rate("b", b) - rate("a", a)).alias("weight")), math.log(max(urls.b, 1) / max(urls.a, 1))


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], examples: DataFrame | None = None, learn_from: Column | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, and ``score``, the method's log-odds of block.

    The longest rule that fits decides. Without one, multinomial naive Bayes
    does: host and path, without what rules look at, are cut into runs of a-z,
    these into words by the unigram counts of all pages' visible text, and the
    words are weighed by their counts in urls that rules block and allow
    (``examples``, with the columns url and verdict, adds labelled urls; only
    rows for which ``learn_from`` holds teach). Words that no labelled url has
    say nothing. A url is blocked for a score above zero, and never without a
    word that is known.

    A null url, or one without ``://``, has an empty host and path, fits no
    rule and teaches nothing; like a url without known words it gets the score
    of the classes' shares. Without labelled urls of both classes scores are of
    these shares and of one class's words. Null ids and repeated rows are judged
    like others; other columns are ignored; an empty table gives no rows.
    """
    host, path = url_parts(F.col(url_col))
    teaches = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), teaches.alias("teaches"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("*", rule.alias("rule"), said.alias("said")), "url-rows")
    bare = unruled_parts(F.col("host"), F.col("path"), rules)

    taught = rows.where("said IS NOT NULL AND teaches").select(F.col("said").alias("verdict"), names_of(*bare).alias("names"))
    if examples is not None:
        own = examples.select("verdict", *(p.alias(c) for p, c in zip(url_parts(F.col("url")), ("host", "path"))))
        taught = taught.unionByName(own.select("verdict", names_of(*unruled_parts(F.col("host"), F.col("path"), rules)).alias("names")))
    named = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("names"))).alias("name")
    labelled = materialize(taught.select("verdict", named).groupBy("verdict", "name").agg(F.count("*").alias("n")), "url-labelled")

    # every pair of host and path is judged once
    open_ = rows.groupBy("host", "path").agg(F.count("*").alias("rows")).select("host", "path", F.explode(names_of(*bare)).alias("name"))
    open_ = materialize(open_, "url-names")
    names = materialize(open_.select("name").union(labelled.where("name IS NOT NULL").select("name")).distinct(), "url-distinct-names")
    split = materialize(segment(names, materialize(page_words(pages, html_col), "url-words")), "url-split")
    weights, prior = word_weights(labelled, split)
    by_name = split.select("name", F.explode("words").alias("word")).join(weights, "word").groupBy("name").agg(F.sum("weight").alias("weight"))
    by_name = materialize(by_name, "url-name-weights")
    sites = materialize(lookup(open_, by_name, "name", row_bytes=64).groupBy("host", "path").agg(F.sum("weight").alias("weight")), "url-sites")
    judged = lookup(rows, sites, ["host", "path"], "left", row_bytes=256)
    score = F.lit(prior) + F.coalesce("weight", F.lit(0.0))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("weight").isNotNull() & (score > 0), "block").otherwise("allow")).alias("verdict"), score.alias("score"))
