"""Values that were cut off, and how often each source cuts (problem 4).

Two kinds of evidence meet in one log-odds for every value.

Lengths. For each source, the lengths of its values are fitted by maximum likelihood with a log-normal distribution in
which values without a proper ending near a candidate limit are right-censored there (only known to have been at least
that long). Limits in characters and in UTF-8 bytes are tried, as many as the source has: a candidate is a length at
which more values without an ending pile up than chance explains (see `_limits`), however small their share. A value's
censoring posterior is the share of the censored mass in all that the fit expects at its length. Sources are fitted
from a histogram of (length, kind of ending), never from their rows.

Endings. A terminal mark, with closing quotes, tags or a credit behind it, is an ending, unless the dot only ends an
abbreviation or stands in a number; marks of omission and broken remnants (half a tag or entity, a replacement
character) are set aside first. Three things are settled by what a cut is: a value with an ending is whole unless its
text is seen to go on within the sentence, a value is whole whose sentence is seen to end there in the full text, and an
unfinished sentence is cut that has a broken remnant behind it, or a mark of omission which the full text confirms. All other values fall into kinds of ending: form, mark, whether the full text
goes on, and where that isn't known how often the last word ends a sentence over all values. What a kind says is its
likelihood ratio, estimated from the values themselves by expectation-maximisation (`likelihood_ratios`): the censoring
posteriors, and a full text that goes on, are the first guess of which values are cut; the posteriors stay their prior odds to the end. No weight is set by hand.

Null and blank values are no cases. Values of rows without a source are fitted together. Values are handled whole.
Repeated rows get equal results; `key` should be unique.
"""

from __future__ import annotations

from math import erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut

MARKS = ".!?。！？।؟۔"
CLOSERS = "\"'”“’»›」』)\\]）】"
_ENDED = f"[{MARKS}][{CLOSERS}\\s]*$"
_OMITTED = "\\s*[\\[(]?(?:\\.\\s?\\.\\s?\\.+|…+)[\\])]?\\s*$"
_BROKEN = "(?:<[^<>]*|&#?[A-Za-z0-9]{0,8}|�+)$"
_TAGS = "(?:\\s*</?[A-Za-z][^<>]*>\\s*)+$"
# Abbreviations of more than two letters, or of letters with vowel signs, that are seldom last in a sentence.
_SHORT = "sta|inc|ltd|ltda|corp|art|env|abs|млн|мин|руб|prof|approx|aprox|डॉ|के|आर|सं|प्रा|लि"
_WEAK_WORD = f"(?iu)(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}])(?:[\\p{{L}}&&[^\\x{{900}}-\\x{{97F}}]]{{1,2}}|{_SHORT})"
_WEAK_DOT = f"{_WEAK_WORD}\\.$|\\d\\.$"  # an abbreviation or a number before the last dot
_WIDE = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{0E00}-\\x{0E7F}]"
CHANCE = 0.01  # that a pile of values is none
TAIL = 200  # an ending and what may stand behind it is seldom longer
WINDOW = 18  # a cut at a word's end is at most so much shorter than its limit
_FIT = "source_id long, n_chars int, n_bytes int, ending string, posterior double"


def _strip_credit(text: Column, site: Column) -> Column:
    """Without a credit to the site at the end: – Site, (Site), | Site."""
    bare = F.rtrim(text)
    with_brackets = F.concat(F.lit("("), site, F.lit(")"))
    cut = F.when(bare.endswith(with_brackets), F.expr("left(__v, length(__v) - length(__site) - 2)"))
    cut = cut.when(bare.endswith(site), F.regexp_replace(F.expr("left(__v, length(__v) - length(__site))"), "[\\s–—|·-]+$", ""))
    return F.when(site.isNotNull() & (F.length(site) > 0), F.coalesce(cut, bare)).otherwise(bare)


def endings(df: DataFrame, key: str, source: str, text: str, site: str) -> DataFrame:
    """(key, source_id, n_chars, n_bytes, core, ending, mark) of every value that isn't null or blank.

    The last TAIL characters are looked at, or all where the tags at the end may begin before them.
    core: what is looked at without tags, credit, omission marks and remnants at their end. ending: `closed`, `weak` (a dot that
    may only end an abbreviation) or `open`. mark: `omitted`, `broken` or empty.
    """
    v = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("long").alias("source_id"), F.rtrim(F.col(f"`{text}`")).alias("__raw"), F.trim(F.col(f"`{site}`")).alias("__site"))
    v = v.where("trim(__raw) <> ''").select("*", F.length("__raw").alias("n_chars"), F.octet_length("__raw").alias("n_bytes"), F.right("__raw", F.lit(TAIL)).alias("__tail"))
    # a last tag that begins before the tail, whole or cut, or a row of tags that fills it
    rest = F.regexp_replace("__tail", _TAGS, "")
    outside = F.when(F.col("__tail").endswith(">"), rest.rlike("^[^<]*>\\s*$") | (F.trim(rest) == "")).otherwise(~F.contains("__tail", F.lit("<")) & F.substring_index("__raw", "<", -1).rlike("^/?[A-Za-z][^<>]*$"))
    v = v.withColumn("__tail", F.when((F.col("n_chars") > TAIL) & F.contains("__raw", F.lit("<")) & outside, F.col("__raw")).otherwise(F.col("__tail")))
    v = v.withColumn("__v", F.rtrim(F.when(F.col("__tail").endswith(">"), F.regexp_replace("__tail", _TAGS, "")).otherwise(F.col("__tail"))))
    v = v.withColumn("__c", F.rtrim(_strip_credit(F.col("__v"), F.col("__site"))))
    broken = F.col("__c").rlike(_BROKEN)
    v = v.withColumn("__d", F.rtrim(F.regexp_replace("__c", _BROKEN, "")))
    omitted = F.col("__d").rlike(_OMITTED)
    v = v.withColumn("mark", F.when(broken, "broken").when(omitted, "omitted").otherwise(""))
    v = v.withColumn("core", F.regexp_replace("__d", _OMITTED, ""))
    ended = F.col("core").rlike(_ENDED)
    weak = F.col("core").endswith(".") & F.col("core").rlike(_WEAK_DOT)
    ending = F.when(ended & weak, "weak").when(ended, "closed").otherwise("open")
    return v.select("key", "source_id", "n_chars", "n_bytes", "core", ending.alias("ending"), "mark")


def _normal(z: float) -> float:
    return 0.5 * (1 + erf(z / sqrt(2)))


def _density(x: float, mu: float, sd: float) -> float:
    return exp(-(((log(x) - mu) / sd) ** 2) / 2) / (x * sd * sqrt(2 * pi)) if x > 0 else 0.0


def censored_fit(exact: dict[int, int], limit: float, censored: int, rounds: int = 30) -> tuple[float, float]:
    """Mean and deviation of log length: maximum likelihood with `censored` values known to be at least `limit`.

    exact: {length: values}. By expectation-maximisation; a censored value counts with its expected first and second
    moment above the limit.
    """
    x = np.log(np.array([k for k in exact if k > 0] or [max(limit, 2)], float))
    n = np.array([v for k, v in exact.items() if k > 0] or [1], float)
    mu = float((x * n).sum() / n.sum())
    sd = max(0.15, float(np.sqrt((n * (x - mu) ** 2).sum() / n.sum())))
    if not censored:
        return mu, sd
    for _ in range(rounds):
        z = (log(limit) - mu) / sd
        above = max(1 - _normal(z), 1e-9)
        ratio = exp(-z * z / 2) / sqrt(2 * pi) / above
        m1 = mu + sd * ratio
        m2 = mu * mu + sd * sd + sd * (log(limit) + mu) * ratio
        total = n.sum() + censored
        new = ((x * n).sum() + censored * m1) / total
        var = ((x * x * n).sum() + censored * m2) / total - new * new
        mu, sd = float(new), float(min(3.0, max(0.15, sqrt(max(var, 1e-6)))))
    return mu, sd


def _unlikely(count: float, expected: float) -> float:
    """Upper bound of the log probability that a Poisson number of mean `expected` reaches `count` (Chernoff)."""
    return 0.0 if count <= expected else count - expected - count * log(count / max(expected, 1e-9))


def _limits(lengths: np.ndarray, n: np.ndarray, loose: np.ndarray) -> list[tuple[int, int]]:
    """Candidate (limit, window): lengths where values without an ending pile up. A strict pile fills one or two
    lengths just below the limit, a loose one (cut at word ends) the WINDOW below it.

    A pile counts if chance, at the density of such values around it, would make one anywhere with probability under
    CHANCE. Piles are taken one by one, the least likely first, without the values of those before."""
    total = float(n[loose].sum())
    if total < 3:
        return []
    counts = np.zeros(int(lengths.max()) + 5)
    np.add.at(counts, lengths[loose], n[loose])
    out = []
    while True:
        run = np.concatenate([[0], np.cumsum(counts)])
        best = (log(CHANCE), 0, 0)
        for width in (3, WINDOW):
            ends = np.flatnonzero(counts > 0)
            ends = ends[ends >= width]
            mass = run[ends + 1] - run[ends + 1 - width]
            low, high = np.maximum(0, ends + 1 - 5 * WINDOW), np.minimum(len(counts), ends + 1 + 4 * WINDOW)
            around = np.maximum(run[high] - run[low] - mass, 1.0) / np.maximum(high - low - width, 1) * width
            for k in np.flatnonzero((mass >= 3) & (mass > 3 * around)):
                chance = _unlikely(float(mass[k]), float(around[k])) + log(len(counts) / width + 1)
                if chance < best[0]:
                    best = (chance, int(ends[k]), width)
        if not best[1]:
            return out
        out.append(best[1:])
        counts[best[1] + 1 - best[2] : best[1] + 1] = 0


def fit_source(hist: pd.DataFrame) -> pd.DataFrame:
    """Censoring posteriors of one source's histogram (source_id, n_chars, n_bytes, ending, n); null where no limit is near."""
    loose = (hist["ending"] == "loose").to_numpy()
    n = hist["n"].to_numpy()
    posterior = np.zeros(len(hist))
    for column in ("n_chars", "n_bytes"):
        lengths = hist[column].to_numpy()
        for limit, width in _limits(lengths, n, loose):
            near = loose & (lengths <= limit) & (lengths > limit - width)
            exact: dict[int, int] = {}
            for k, v in zip(lengths[~near], n[~near]):
                exact[int(k)] = exact.get(int(k), 0) + int(v)
            mu, sd = censored_fit(exact, limit, int(n[near].sum()))
            # the share of all values that end here because of the limit, by the counts
            mass = float(n[near].sum()) / float(n.sum())
            for k in np.flatnonzero(near):
                p = mass / width / (mass / width + (1 - mass) * _density(float(lengths[k]), mu, sd))
                posterior[k] = max(posterior[k], min(p, 0.995))
    out = hist[["source_id", "n_chars", "n_bytes", "ending"]].copy()
    out["posterior"] = np.where(loose & (posterior > 0), posterior, np.nan)
    return out


def likelihood_ratios(counts: list[tuple[str, float | None, int]], rounds: int = 60) -> tuple[dict[str, float], float]:
    """({kind: log likelihood ratio of cut against whole}, share of cut values away from any limit).

    counts: [(kind of ending, censoring posterior or None, values)]; values that are settled have the kind `cut` or
    `whole`. Expectation-maximisation of a mixture of cut and whole values: the posterior is a value's prior; where
    there is none, a common share, which is estimated too."""
    kinds = sorted({k for k, _, _ in counts})
    at = np.array([kinds.index(k) for k, _, _ in counts], np.int64)
    prior = np.array([np.nan if p is None else p for _, p, _ in counts], float)
    n = np.array([float(c) for _, _, c in counts])
    away = np.isnan(prior)
    share, ratio = 0.1, np.array([3.0 if k.endswith(" on") else 0.0 for k in kinds])  # a first guess only
    for _ in range(rounds if len(n) else 0):
        p = np.clip(np.where(away, share, prior), 1e-6, 1 - 1e-6)
        odds = np.log(p / (1 - p)) + ratio[at]
        cut_ = np.where([k == "cut" for k, _, _ in counts], 1.0, np.where([k == "whole" for k, _, _ in counts], 0.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))))
        of_cut, of_whole = np.bincount(at, n * cut_, len(kinds)) + 0.5, np.bincount(at, n * (1 - cut_), len(kinds)) + 0.5
        ratio = np.log(of_cut / of_cut.sum()) - np.log(of_whole / of_whole.sum())
        share = float(np.clip((n * cut_)[away].sum() / max(n[away].sum(), 1.0), 0.001, 0.999))
    return dict(zip(kinds, ratio.tolist())), share


def censoring(ended: DataFrame) -> DataFrame:
    """(source_id, n_chars, n_bytes, ending, posterior) from the values' histogram; ending: `loose` or `closed`."""
    kind = F.when((F.col("ending") == "closed") & (F.col("mark") == ""), "closed").otherwise("loose")
    hist = ended.groupBy(F.coalesce("source_id", F.lit(-1).cast("long")).alias("source_id"), "n_chars", "n_bytes", kind.alias("ending")).agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_source(pdf)

    return hist.groupBy("source_id").applyInPandas(fit, _FIT)


def _last_word(core: Column) -> Column:
    """The last word in lower case; in scripts without spaces, the last two characters."""
    bare = F.regexp_replace(core, "[^\\p{L}\\p{M}\\p{N}]+$", "")
    return F.when(bare.rlike(_WIDE + "$"), F.right(bare, F.lit(2))).otherwise(F.lower(F.regexp_extract(bare, "([\\p{L}\\p{M}\\p{N}'’-]+)$", 1)))


def word_ends(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, ends, seen) for each of `words` over all `texts` (text): how often it stands before a terminal mark."""
    wide = F.col("text").rlike(_WIDE)
    tokens = texts.select(
        F.explode(F.when(wide, F.expr("transform(sequence(1, greatest(length(text) - 2, 1)), i -> substr(text, i, 3))")).otherwise(F.split(F.lower("text"), "\\s+"))).alias("t"), wide.alias("wide")
    )
    counted = tokens.groupBy("t", "wide").agg(F.count("*").alias("n"))  # what follows looks at distinct tokens only
    word = F.when(F.col("wide"), F.left("t", F.lit(2))).otherwise(F.regexp_extract("t", "([\\p{L}\\p{M}\\p{N}'’-]+)[^\\p{L}\\p{M}\\p{N}]*$", 1))
    end = F.when(F.col("wide"), F.right("t", F.lit(1)).rlike(f"[{MARKS}]")).otherwise(F.col("t").rlike(f"[^.][{MARKS}][{CLOSERS}]*$"))
    each = counted.select(word.alias("word"), (end.cast("long") * F.col("n")).alias("e"), "n")
    return each.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("e").alias("ends"), F.sum("n").alias("seen"))


def _going_on(core: Column, full: Column, words: int) -> Column:
    """What follows the last `words` characters of the value in the full text; null where they aren't there."""
    tail = F.right(core, F.lit(words))
    at = F.instr(full, tail)
    return F.when((F.length(tail) >= 8) & (at > 0), F.substr(full, at + F.length(tail), F.lit(12)))


def truncated(df: DataFrame, key: str, source: str, text: str, site: str, full: DataFrame, full_key: str, full_text: str) -> DataFrame:
    """(key, source_id, truncated, log_odds, posterior, ending, mark) for every value that isn't null or blank.

    `full` has full texts (`full_text`) under `full_key`; rows may be missing or repeated."""
    ended = cut(endings(df, key, source, text, site))
    unsure = ended.where("ending <> 'closed' or mark <> ''")
    texts = full.select(F.col(f"`{full_key}`").alias("key"), F.col(f"`{full_text}`").alias("__full")).where("__full is not null")
    after = F.coalesce(_going_on(F.col("core"), F.col("__full"), 48), _going_on(F.col("core"), F.col("__full"), 24))
    seen = unsure.select("key", "core", "ending").join(texts, "key").select("key", "core", "ending", after.alias("after")).where("after is not null")
    weak = F.col("core").rlike(_WEAK_WORD + "\\.?$")
    marked = F.col("after").rlike(f"^[{CLOSERS}]*\\s*[{MARKS}…]") & ~F.col("after").rlike(f"^[{CLOSERS}]*\\s*[{MARKS}…]+[{CLOSERS}\\s]*[,،\\p{{Ll}}]|^\\.\\s*\\d") & ~(weak & F.col("after").startswith("."))
    stops = marked | F.col("after").rlike("^\\s*(?:\\n|$)")
    begins = F.col("after").rlike("^\\s*(?:\\n|$|[«“„—–\"]?\\s*[¿¡«“]?[\\p{Lu}\\x{600}-\\x{6FF}\\x{900}-\\x{97F}\\x{E00}-\\x{E7F}\\x{3040}-\\x{9FFF}])")
    count = lambda c: F.length("core") - F.length(F.translate("core", c, ""))
    quoting = (count("“«「『„") > count("”»」』")) & ~F.col("core").rlike("„[^“”]*[“”][^„]*$")
    goes_on = F.when(F.col("ending") == "open", ~stops | (quoting & ~F.col("after").rlike(f"^\\s*[{MARKS}…]*\\s*[{CLOSERS}]"))).otherwise(~begins | quoting | (weak & F.col("after").rlike("^\\s*\\S")))
    known = seen.select("key", goes_on.cast("int").alias("goes_on")).groupBy("key").agg(F.max("goes_on").alias("goes_on"))

    judged = unsure.join(known, "key", "left").withColumn("word", _last_word(F.col("core")))
    guess = judged.where("goes_on is null")
    ends = word_ends(df.select(F.col(f"`{text}`").alias("text")).where("trim(text) <> ''"), guess.select("word"))
    judged = judged.join(ends, "word", "left")
    rate = (F.coalesce("ends", F.lit(0)) + 0.02) / (F.coalesce("seen", F.lit(0)) + 1.0)
    by_word = F.when(F.col("word") == "", "none").otherwise(F.round(F.greatest(F.lit(-6.0), F.log(rate)), 0).cast("int").cast("string"))
    follows = F.when(F.col("goes_on") == 1, "on").otherwise(F.when((F.col("ending") == "open") & (F.col("mark") == ""), by_word).otherwise("?"))
    settled = F.when((F.col("goes_on") == 0) | ((F.col("ending") == "closed") & F.col("goes_on").isNull()), False).when((F.col("ending") == "open") & ((F.col("mark") == "broken") | ((F.col("mark") == "omitted") & (F.col("goes_on") == 1))), True)
    fits = censoring(ended).where("ending = 'loose' and posterior is not null and not isnan(posterior)").drop("ending")
    judged = judged.select("key", F.coalesce("source_id", F.lit(-1).cast("long")).alias("source_id"), "n_chars", "n_bytes", "ending", "mark", settled.alias("settled"), F.concat_ws(" ", "ending", "mark", follows).alias("kind"))
    judged = cut(judged.join(fits, ["source_id", "n_chars", "n_bytes"], "left"))
    sure = ended.where("ending = 'closed' and mark = ''").select("key", F.coalesce("source_id", F.lit(-1).cast("long")).alias("source_id"), F.lit(False).alias("truncated"), F.lit(float("-inf")).alias("log_odds"), F.lit(0.0).alias("posterior"), "ending", "mark")
    kind = F.when(F.col("settled"), "cut").when(~F.col("settled"), "whole").otherwise(F.col("kind"))
    counts = judged.groupBy(kind.alias("kind"), F.round("posterior", 2).alias("p")).agg(F.count("*").alias("n")).collect()  # kinds of ending by hundredths: some thousand rows at most
    ratios, share = likelihood_ratios([(r["kind"], r["p"], r["n"]) for r in counts] + [("whole", None, sure.count())])
    table = judged.sparkSession.createDataFrame(sorted(ratios.items()), "kind string, ratio double")
    judged = judged.join(F.broadcast(table), "kind", "left").withColumn("posterior", F.coalesce("posterior", F.lit(share)))
    odds = F.when(~F.col("settled"), float("-inf")).when(F.col("settled"), float("inf")).otherwise(F.log(F.col("posterior") / (1 - F.col("posterior"))) + F.col("ratio"))
    judged = judged.select("key", "source_id", (odds > 0).alias("truncated"), odds.alias("log_odds"), "posterior", "ending", "mark")
    both = judged.unionByName(sure)
    return both.select(F.col("key").alias(key), F.nullif("source_id", F.lit(-1).cast("long")).alias("source_id"), "truncated", "log_odds", "posterior", "ending", "mark")
