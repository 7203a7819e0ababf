"""Quality rules: text statistics and a decision list learned from labelled documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words_of

#: Words of a repetition window.
REPEAT = 8
#: Statistics that a rule may test.
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share")
#: Labelled documents that rules are learned from, at most.
SAMPLE = 10_000
#: Cuts of a feature that are tried.
CUTS = 31
#: Shares of the sample at either end where a feature is cut as well.
TAIL = (0.001, 0.003, 0.01)
#: Share of rejected documents among those that a rule catches in the pruning part, and their least number.
PRECISION, COVER = 0.9, 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(f"stats.{self.feature}")
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    here = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(REPEAT), F.get(p, i + 1) - x)), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_bound(_bound(here, repeated), covered))


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc, stats): each row whole, and its text's statistics.

    A text is null or any string; null counts as without words. Windows of
    eight words are compared by a 64-bit hash of the words' hashes, within one
    text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = step.select("doc", "text", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.char_length(F.array_join("words", "")).alias("chars"), lines.alias("lines"))
    n = F.size("hashes")
    h = F.col("hashes")
    window = F.transform(F.sequence(F.lit(0), n - REPEAT), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(REPEAT)]))
    step = step.select(
        "doc", n.alias("n"), "chars",
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", ""))).alias("symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup_lines"),
        F.size(F.array_distinct("hashes")).alias("distinct"), F.when(n >= REPEAT, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    step = step.select("doc", "n", "chars", "symbols", "n_lines", "dup_lines", "distinct", _repeat_words(F.col("windows")).alias("repeat"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    stats = F.struct(
        F.col("n").cast("long").alias("n_words"), F.col("chars").cast("long").alias("word_chars"), F.col("symbols").cast("long").alias("n_symbols"), F.col("dup_lines").cast("long").alias("n_dup_lines"), F.col("repeat").cast("long").alias("n_repeat_words"),
        share("chars", "n").alias("mean_word_chars"), share("symbols", "n").alias("symbols_per_word"), share("dup_lines", "n_lines").alias("dup_line_share"), share("repeat", "n").alias("repeat_share"), share("distinct", "n").alias("distinct_share"),
    )
    # behind a generator, so that a filter on the statistics is not moved down and works them out again for each of its terms
    return step.select("doc", F.explode(F.array(stats)).alias("stats"))


def base_failed() -> Column:
    s = F.col("stats")
    return (s["n_words"] < 20) | (s["n_repeat_words"] * 100 > s["n_words"] * 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of at most ``sample`` labelled documents, by hash of the id: (stats, bad, prune).

    A document labelled more than once counts as bad if any label says so.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("label_quality"))
    chosen = one.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    marked = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("labelled")).select(docs["doc_id"], docs["text"], (F.col("label_quality") == 0).alias("bad"))
    part = F.pmod(F.xxhash64("doc.doc_id", F.lit(3)), F.lit(3)) == 0
    return with_stats(marked).where(~base_failed()).select("stats", F.col("doc.bad").alias("bad"), part.alias("prune"))


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def learn(sample: DataFrame) -> list[Rule]:
    """A decision list for the bad class by sequential covering.

    A rule grows by the condition of the largest gain (FOIL) until it catches
    no good document of the growing part or gains nothing. It is then cut back
    to the prefix with the best precision in the pruning part and kept if that
    is good enough; what it catches goes. What a rule that is not kept catches
    goes from the growing part alone, so that another can be sought. It ends
    when a rule catches too few to be told from chance. All counts are grouped
    aggregates; the driver holds the counts of a feature's cuts.
    """
    cuts = sample.agg(*[F.percentile_approx(f"stats.{f}", [*TAIL, *[i / (CUTS + 1) for i in range(1, CUTS + 1)], *[1 - t for t in TAIL]], 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(map(float, cuts[f] or []))) for f in FEATURES}
    place = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: F.col(f"stats.{f}") > c)) if cuts[f] else F.lit(0)
    rest = stored(sample.select("stats", "bad", "prune", F.array(*map(place, FEATURES)).alias("places")), "rule-sample")
    rules: list[Rule] = []
    while True:
        rule: Rule = ()
        while True:
            inside = rest.where(~F.col("prune")).where(_all(rule))
            counts = inside.select("bad", F.posexplode("places").alias("feature", "place")).groupBy("feature", "place").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = _best_condition(counts, cuts)
            if best is None:
                break
            rule, caught = (*rule, best[0]), best[2]
            if best[1] == 0:
                break
        if not rule or caught < COVER:
            return rules
        kept = _pruned(rest, rule)
        rules += [kept] if kept else []
        rest = rest.where(~_all(kept) if kept else F.col("prune") | ~_all(rule))


def _best_condition(counts: list, cuts: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    """The condition of the largest gain, and the good and bad documents that it still catches."""
    best, gain = None, 0.0
    for number, feature in enumerate(FEATURES):
        mine = {r["place"]: (r["p"], r["n"]) for r in counts if r["feature"] == number}
        p, n = (sum(x[i] for x in mine.values()) for i in (0, 1))
        if not p or not n:
            continue
        low_p = low_n = 0
        for place, cut in enumerate(cuts[feature]):
            low_p, low_n = low_p + mine.get(place, (0, 0))[0], low_n + mine.get(place, (0, 0))[1]
            for above, a, b in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                if a and (found := a * (log2(a / (a + b)) - log2(p / (p + n)))) > gain:
                    best, gain = (Condition(feature, above, cut), b, a), found
    return best


def _pruned(rest: DataFrame, rule: Rule) -> Rule:
    """The most precise prefix of a rule in the pruning part, or nothing if that is not good enough."""
    if not rule:
        return ()
    prefixes = [rule[: i + 1] for i in range(len(rule))]
    found = rest.where(F.col("prune")).agg(*[F.count_if(_all(r) & (F.col("bad") if bad else ~F.col("bad"))).alias(f"{'p' if bad else 'n'}{i}") for i, r in enumerate(prefixes) for bad in (True, False)]).first()
    scored = [((found[f"p{i}"] / max(1, found[f"p{i}"] + found[f"n{i}"])), -i) for i in range(len(prefixes))]
    precision, i = max(scored)
    return prefixes[-i] if precision >= PRECISION and found[f"p{-i}"] >= COVER else ()


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that a document meets, from 1; 0 for none."""
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule), F.lit(number)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc, stats, base_failed, rule, kept) of every row of ``docs`` (doc_id, text, ...).

    ``kept`` is false where the base limits fail or a learned rule catches the
    document. Statistics cover all rows and whole texts; only the rules are
    learned from a sample of ``labels`` (doc_id, quality), of at most ``sample``
    documents.

    Defined results: a null or empty text has no words and fails; a null id is
    judged like any other and is never labelled; repeated rows are judged each;
    without usable labels there are no rules; an empty table gives no rows;
    further columns stay inside ``doc`` whatever their names.
    """
    rules = learn(labelled_sample(docs, labels, sample))
    out = with_stats(docs).withColumns({"base_failed": base_failed(), "rule": first_rule(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their own columns."""
    return judged(docs, labels, sample).where("kept").select("doc.*")
