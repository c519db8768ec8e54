"""Quality rules as weak supervision, with DataFrame and SQL functions alone.

Each rule looks at a document's counts and votes to keep it (1), to reject it (-1) or abstains (0). Nobody says which
documents are good: expectation-maximisation estimates, from all documents' votes, how often each rule keeps, rejects
and abstains on good and on bad documents, and how many are good. A document's posterior probability of being good is
its quality.

The rules are few, so documents have at most 3**rules vote patterns; the estimate runs over the patterns' counts,
whatever the number of documents.

Null, empty and blank texts have no words, fail the base rules and are not kept. Repeated rows get equal results. An
empty table gives an empty result. Windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE_RUN, stored

#: Rounds of expectation-maximisation.
ROUNDS = 30
#: How often a rule keeps and rejects good and bad documents at the start, and how many imagined documents say so.
GOOD, BAD, IMAGINED = (0.985, 0.005), (0.6, 0.3), 4
#: A text fails at once with fewer words, or with more than so many per cent of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words of a window.
WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"


def _share(a: str, b: str) -> str:
    return f"({a} / greatest({b}, 1))"


#: name -> (SQL condition to reject, SQL condition to keep); between both the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 15", "n_words >= 40"),
    "word_length": (f"{_share('word_chars', 'n_words')} not between 2 and 14", f"{_share('word_chars', 'n_words')} between 3 and 10"),
    "symbols": (f"{_share('n_symbols', 'n_words')} > 0.1", f"{_share('n_symbols', 'n_words')} < 0.02"),
    "signs": (f"{_share('n_signs', 'word_chars')} > 0.2", f"{_share('n_signs', 'word_chars')} < 0.1"),
    "lines": (f"{_share('n_dup_lines', 'n_lines')} > 0.3", f"{_share('n_dup_lines', 'n_lines')} < 0.1"),
    "repeats": (f"{_share('n_repeat_words', 'n_words')} > 0.15", f"{_share('n_repeat_words', 'n_words')} < 0.05"),
    "capitals": (f"{_share('n_capitals', 'word_chars')} > 0.3", f"{_share('n_capitals', 'word_chars')} < 0.1"),
    "stops": (f"{_share('n_stops', 'n_words')} < 0.005", f"{_share('n_stops', 'n_words')} between 0.01 and 0.4"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules look at. Names that docs has already are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(t, F.lit(SPACES))
    df = docs.withColumn("_t", t).withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long"),
        "n_capitals": (F.length("_t") - F.length(F.regexp_replace("_t", "[\\p{Lu}]+", ""))).cast("long"),
        "n_signs": (F.length("_t") - F.length(F.regexp_replace("_t", "[^\\p{L}\\p{N}\\s]+", ""))).cast("long"),
        "n_stops": F.size(F.split("_t", "[.!?](?=[\\s]|$)")).cast("long") - 1,
        "_lines": F.expr(f"filter(split(_t, '\n'), l -> trim(both '{SPACES}' from l) <> '')"),
        # a hash of each window of words
        "_seen": F.expr(f"if(size(_words) < {WINDOW}, array(), transform(sequence(0, size(_words) - {WINDOW}), i -> xxhash64({', '.join(f'_words[i + {k}]' for k in range(WINDOW))})))"),
    })
    df = df.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    # hashes with their places, sorted: equal windows are neighbours
    df = df.withColumn("_sorted", F.expr("if(size(array_distinct(_seen)) = size(_seen), array(), array_sort(transform(_seen, (h, i) -> struct(h, i))))"))
    df = df.withColumn("_again", F.expr("array_sort(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h or x.h = get(_sorted, k + 1).h), x -> x.i))"))
    df = df.withColumn("n_repeat_words", F.expr(f"aggregate(transform(_again, (p, k) -> least({WINDOW}, coalesce(get(_again, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)"))
    return df.drop("_t", "_words", "_lines", "_seen", "_sorted", "_again")


def votes() -> Column:
    """Each rule's vote, as an array of 1, -1 and 0."""
    return F.array(*[F.expr(f"case when {reject} then -1 when {keep} then 1 else 0 end") for reject, keep in RULES.values()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def estimated(patterns: DataFrame) -> DataFrame:
    """(votes, quality) of each vote pattern, from (votes, n).

    State: the share of good documents, and how often each rule keeps (k), rejects (r) and abstains (a) on good and on
    bad ones. All rates are free, but for IMAGINED documents that keep them off 0 and 1; a rule that comes out worse
    than chance gets the same rates for both and has no say.
    """
    k = len(RULES)
    weight = lambda rates, share: f"aggregate(zip_with({rates}, p.votes, (a, v) -> case v when 1 then a.k when -1 then a.r else a.a end), {share}, (x, y) -> x * y)"
    posterior = lambda s: f"({weight(f'{s}.good', f'{s}.share')} / ({weight(f'{s}.good', f'{s}.share')} + {weight(f'{s}.bad', f'1 - {s}.share')}))"
    added = lambda to, w, when: f"zip_with({to}, p.votes, (a, v) -> a + if({when}, {w}, 0D))"
    struct = lambda k, r, a: f"named_struct('k', {k}, 'r', {r}, 'a', {a})"
    start = lambda of: f"array_repeat({struct(f'{of[0]}D', f'{of[1]}D', f'{1 - sum(of):.6f}D')}, {k})"
    rate = lambda n, of, total: f"({n} + {IMAGINED * of:.6f}D) / ({total} + {IMAGINED}D)"
    rates = lambda kept, rejected, of, total: f"zip_with({kept}, {rejected}, (x, y) -> {struct(rate('x', of[0], total), rate('y', of[1], total), rate(f'greatest(0D, {total} - x - y)', 1 - sum(of), total))})"
    pooled = struct(*[f"(t.good * g.{x} + (t.n - t.good) * b.{x}) / t.n" for x in "kra"])
    held = lambda own: f"zip_with(t.g, t.b, (g, b) -> if(g.k < b.k or g.r > b.r, {pooled}, {own}))"
    zero = f"array_repeat(0D, {k})"
    step = (
        f"aggregate(transform(_all, p -> struct(p.votes as votes, cast(p.n as double) as n, {posterior('s')} as q)), "
        f"named_struct('n', 0D, 'good', 0D, 'kg', {zero}, 'rg', {zero}, 'kb', {zero}, 'rb', {zero}), "
        f"(t, p) -> named_struct('n', t.n + p.n, 'good', t.good + p.n * p.q, 'kg', {added('t.kg', 'p.n * p.q', 'v = 1')}, 'rg', {added('t.rg', 'p.n * p.q', 'v = -1')}, "
        f"'kb', {added('t.kb', 'p.n * (1 - p.q)', 'v = 1')}, 'rb', {added('t.rb', 'p.n * (1 - p.q)', 'v = -1')}), "
        f"s -> transform(array(named_struct('n', s.n, 'good', s.good, 'g', {rates('s.kg', 's.rg', GOOD, 's.good')}, 'b', {rates('s.kb', 's.rb', BAD, '(s.n - s.good)')})), "
        f"t -> named_struct('share', least(0.98D, greatest(0.3D, (t.good + 9) / (t.n + 10))), 'good', {held('g')}, 'bad', {held('b')}))[0])"
    )
    start = f"named_struct('share', 0.8D, 'good', {start(GOOD)}, 'bad', {start(BAD)})"
    # one row: at most 3**rules patterns
    gathered = patterns.groupBy().agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("_all"))
    fitted = gathered.withColumn("_state", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, _i) -> {step})"))
    return fitted.select(F.explode("_all").alias("p"), F.col("_state").alias("s")).select("p.votes", F.expr(posterior("s")).alias("quality"))


def quality_votes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, base_failed, quality, kept) of each row."""
    counted = stored(with_counts(docs.select(F.col(key), F.col(text)), text).select(key, *COUNTS, base_failed().alias("base_failed"), votes().alias("votes")), "votes")
    found = estimated(counted.groupBy("votes").agg(F.count("*").alias("n")))
    joined = counted.join(F.broadcast(found), "votes")
    return joined.select(key, *COUNTS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"))


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep. All columns stay as they are, whatever their names.

    Rows are written once with their votes, so that the counts of a text are taken once.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    voted = stored(with_counts(rows, "_text").select("_row", votes().alias("_votes"), base_failed().alias("_failed")), "voted")
    patterns = stored(voted.groupBy(F.col("_votes").alias("votes")).agg(F.count("*").alias("n")), "patterns")
    found = F.broadcast(estimated(patterns).withColumnRenamed("votes", "_votes"))  # at most 3**rules rows
    return voted.where("not _failed").join(found, "_votes").where("quality >= 0.5").select("_row.*")
