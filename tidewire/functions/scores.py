"""Numeric expressions: scores, classes and decisions. All thresholds are parameters with the defaults of the system re-expressed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives in hours, action signals, weights of the personal score.
HALF_LIVES = {"breaking": 6.0, "daily": 24.0, "analytics": 168.0, "reference": 720.0}
PERSONAL_WEIGHTS = {"topic": 0.18, "entity": 0.20, "source": 0.10, "session": 0.15, "embedding": 0.08, "seen": 0.30, "block": 1.00}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mapping(key: Column, table: dict, default) -> Column:
    return reduce(lambda other, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(other), table.items(), F.lit(default))  # null keys get the default


def grade(reliability: Column, cluster_sources: Column, contradiction: Column) -> Column:
    good = reliability.isin("A", "B")
    return F.when(contradiction, 5).when(good & (cluster_sources >= 2), 1).when(good, 2).when(reliability == "C", 3).when(reliability.isin("D", "E"), 4).otherwise(6)


def is_uncertain(reliability: Column, cluster_sources: Column) -> Column:
    return reliability.isin("D", "E") & (cluster_sources <= 1)


def http_class(status: Column, failed: Column) -> Column:
    """failed: kind of failure without a status (``network``, ``rss_parse``) or null."""
    return F.when(status == 429, "http_429").when(status.between(400, 499), "http_4xx").when(status.between(500, 599), "http_5xx").otherwise(F.coalesce(failed, F.lit("unknown")))


def confidence(documents: Column, trust: Column, mean_grade: Column, conflict: Column) -> Column:
    def rule(n: int, t: float, g: float) -> Column:
        return (documents >= n) & (trust >= t) & (mean_grade <= g)

    return F.when(documents == 0, "LOW").when(rule(3, 0.8, 2) & ~conflict, "TOP").when(rule(2, 0.6, 3), "HIGH").when(rule(1, 0.4, 4), "MEDIUM").otherwise("LOW")


def capped_confidence(label: Column, cap: Column, groundedness: Column) -> Column:
    order = F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "TOP")))
    least = F.least(F.array_position(order, label), F.array_position(order, cap)).cast("int")
    return F.when(groundedness < 0.45, "LOW").otherwise(F.element_at(order, least))


def backpressure(backlog: Column, priority: Column, trust: Column) -> Column:
    return F.when(backlog < 1000, "none").when(backlog < 5000, "warn").when(backlog < 10000, F.when(priority == "control", "skip").otherwise("warn")).otherwise(F.when((priority == "continuous") | (trust >= 0.85), "warn").otherwise("skip"))


def decay(age_hours: Column, kind: Column) -> Column:
    """1 now, a half after the kind's half-life; 0.5 for an unknown age."""
    return F.when(age_hours.isNull(), 0.5).otherwise(F.exp(-F.log(F.lit(2.0)) * F.greatest(age_hours, F.lit(0.0)) / mapping(kind, HALF_LIVES, 24.0)))


def final_score(rerank: Column, retrieval: Column, trust: Column, grade_: Column, freshness: Column, zone: Column, value: Column | None = None, match: Column | None = None) -> Column:
    """Blend of relevance, trust, grade and freshness, with the title's boost and the query match."""
    neutral = F.abs(rerank - 0.5) < 0.01
    r = clamp(retrieval)
    relevance = F.when(neutral, 0.80 * r + 0.20 * rerank).otherwise(0.70 * rerank + 0.30 * r)
    raw = 0.50 * relevance + 0.20 * trust + 0.15 * (1.0 - (grade_ - 1) / 5.0) + 0.15 * clamp(freshness)
    if value is not None:
        raw = F.when(value.isNull(), raw).otherwise(0.80 * raw + 0.20 * clamp(value))
    boost = F.when(zone == "title", 1.2).otherwise(1.0)
    if match is not None:
        boost = F.when(match < 0.05, 1.0).otherwise(boost)
    score = F.least(F.lit(1.0), raw * boost)
    if match is not None:
        m = clamp(match)
        mixed = 0.86 * score + 0.14 * m
        score = F.when(match.isNull(), score).otherwise(F.when(neutral & (m < 0.20), mixed * 0.92).otherwise(mixed))
    return F.least(F.lit(1.0), score)


def hit_ratio(terms: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when((F.size(terms) > 0) & (low != ""), F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)).otherwise(0.0)


def query_match(terms: Column, query: Column, title: Column, lead: Column, metadata: Column, body: Column) -> Column:
    seen = F.lower(F.concat_ws(" ", title, lead))
    phrase = (F.char_length(query) >= 8) & F.contains(seen, F.lower(query))
    numbers = F.filter(terms, lambda t: t.rlike(r"^\d+$"))
    number = F.exists(numbers, lambda t: F.contains(seen, t) | F.contains(body, t))
    score = 0.42 * hit_ratio(terms, title) + 0.24 * hit_ratio(terms, lead) + 0.22 * hit_ratio(terms, metadata) + 0.12 * hit_ratio(terms, F.substring(body, 1, 4000))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.least(F.lit(1.0), score + F.when(phrase, 0.20).otherwise(0.0) + F.when(number, 0.10).otherwise(0.0)))


def selection_score(match: Column, retrieval: Column, lexical: Column) -> Column:
    return 0.62 * match + 0.33 * clamp(retrieval) + F.when(lexical, 0.05).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def cosine01(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), clamp((cosine(a, b) + 1) / 2)).otherwise(0.0)


def signal(action: Column, dwell: Column) -> Column:
    long = F.coalesce(dwell >= 45, F.lit(False))
    return F.when(action.isin("like", "share"), 1.0).when(action == "save", 0.8).when(action == "dislike", -1.0).when(action == "hide", -0.8).when(action.isin("click", "read") & long, 0.7).when(action == "click", 0.3).when(action == "read", 0.5).otherwise(0.0)


def ewma_step(weight: Column, s: Column, alpha: float = 0.25) -> Column:
    # four digits by plain arithmetic, which any engine repeats bit for bit
    return F.floor(clamp((1.0 - alpha) * weight + alpha * clamp((s + 1.0) / 2.0)) * 10000 + 0.5) / 10000


def mean_affinity(weights: Column) -> Column:
    """Mean of the weights over 0.5, 0 at least; 0 for none."""
    n = F.size(weights)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.aggregate(weights, F.lit(0.0), lambda s, x: s + x) / n - 0.5)).otherwise(0.0)


def source_affinity(preference: Column, implicit: Column) -> Column:
    """1 or -1 for stated preferences, else the learned score's distance from 0.5 outside a dead band."""
    a = clamp(implicit - 0.5, -0.5, 0.5)
    return F.when(preference == "preferred", 1.0).when(preference == "blocked", -1.0).when(F.abs(a) >= 0.2, a).otherwise(0.0)


def personal_score(base: Column, topic: Column, entity: Column, source: Column, session: Column, embedding: Column, seen: Column, grade_: Column, uncertain: Column, blocked: Column) -> Column:
    w = PERSONAL_WEIGHTS
    cap = F.when(uncertain, 0.03).when(grade_ >= 5, 0.03).when(grade_ == 4, 0.06).otherwise(0.12)
    up = F.least(w["topic"] * topic + w["entity"] * entity + w["source"] * F.greatest(F.lit(0.0), source) + w["session"] * session + w["embedding"] * embedding, cap)
    down = w["source"] * F.abs(F.least(F.lit(0.0), source)) + w["seen"] * seen.cast("double") + w["block"] * blocked.cast("double")
    return clamp(base + up - down)


def trend(current: Column, baseline: Column, sources: Column) -> Column:
    wide = (current >= 3.0) & (sources >= 2)
    ratio = F.try_divide(current, baseline)
    return F.when(baseline <= 0, F.when((current > 0) & wide, "ascending").otherwise("stable")).when((ratio >= 1.25) & wide, "ascending").when(ratio <= 0.75, "descending").otherwise("stable")


def value_score(trust: Column, age_hours: Column, breaking: Column, full: Column, cluster_sources: Column) -> Column:
    """Stored value: freshness isn't clamped, so a date to come gives more than 1."""
    fresh = F.exp(-F.log(F.lit(2.0)) * age_hours / F.when(breaking, 1.0).otherwise(24.0))
    return trust * fresh * F.when(full, 1.0).otherwise(0.3) * F.least(F.lit(1.0), cluster_sources / 3.0)


def context_quality(trust: Column, mean_grade: Column, diversity: Column, documents: Column) -> Column:
    return F.round(0.40 * trust + 0.25 * F.greatest(F.lit(0.0), 1.0 - (mean_grade - 1.0) / 5.0) + 0.20 * diversity + 0.15 * F.least(F.lit(1.0), documents / 3.0), 4)


def _rate(rate: Column, low: Column | float) -> Column:
    return F.coalesce(rate < low, F.lit(False))


def health(failures: Column, parse: Column, extraction: Column, staleness: Column, recent_4xx: Column, errors: Column, skips: Column, items_dev: Column, duplicate_dev: Column, lenient: Column | None = None, floor: Column | None = None) -> tuple[Column, Column]:
    """Status green, yellow or red by ordered rules, and the list of reasons. Nulls never raise a reason."""
    lenient = F.lit(False) if lenient is None else lenient
    red_floor = F.when(lenient & floor.isNotNull(), floor).otherwise(0.50) if floor is not None else F.lit(0.50)
    yellow_floor = F.when(lenient, 0.70).otherwise(0.90)
    over = lambda c, x: F.coalesce(c > x, F.lit(False))
    red = [(recent_4xx, "recent_http_4xx"), (failures >= 5, "consecutive_failures_red"), (_rate(parse, 0.70), "parse_success_red"), (_rate(extraction, red_floor), "extraction_success_red"), (over(staleness, 10), "staleness_red")]
    yellow = [(failures.between(2, 4), "consecutive_failures_yellow"), (_rate(parse, 0.95) & ~_rate(parse, 0.70), "parse_success_yellow"), (_rate(extraction, yellow_floor) & ~_rate(extraction, red_floor), "extraction_success_yellow"), (over(staleness, 3) & ~over(staleness, 10), "staleness_yellow"), (over(errors, 5), "http_errors_yellow"), (over(skips, 0), "backpressure_skips_yellow"), (over(F.abs(items_dev), 0.50), "items_in_feed_deviation_yellow"), (over(F.abs(duplicate_dev), 0.30), "duplicate_rate_deviation_yellow")]
    either = lambda rules: reduce(lambda a, r: a | r[0], rules, F.lit(False))
    order = [red[0], red[1], yellow[0], red[2], yellow[1], red[3], yellow[2], red[4], *yellow[3:]]
    return F.when(either(red), "red").when(either(yellow), "yellow").otherwise("green"), F.array_compact(F.array(*(F.when(c, name) for c, name in order)))


def jitter(key: Column, interval: Column, ratio: float) -> Column:
    """A stable shift within +-ratio of the interval, from a hash of the key."""
    unit = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return (unit * 2 - 1) * ratio * interval


def duration(started: Column, finished: Column) -> Column:
    """Seconds between two times, 0 at least."""
    return F.greatest(F.lit(0.0), (F.unix_micros(finished) - F.unix_micros(started)) / 1e6)


# Hours after which a source is late, by key; seconds that results are cached, by kind of information.
STALE_HOURS = {"tass": 1.0, "ria": 1.0, "lenta": 2.0, "ixbt": 12.0, "habr": 6.0, "kommersant_main": 24.0, "aif_articles": 24.0}
CACHE_SECONDS = {"breaking": 120, "daily": 300, "analytics": 1800, "reference": 3600}


def expected_staleness(key: Column, interval: Column, table: dict[str, float] = STALE_HOURS) -> Column:
    """Hours after which a source is late: stated by key, else a fifteenth of its interval (minutes), 1 at least."""
    return F.coalesce(mapping(key, table, None).cast("double"), F.greatest(F.lit(1.0), interval / 15.0))


def staleness(latest: Column, as_of: Column, expected: Column) -> Column:
    return F.try_divide((F.unix_micros(as_of) - F.unix_micros(latest)) / 3.6e9, F.when(expected > 0, expected))


def next_interval(health_: Column, streak: Column, interval: Column, base: Column) -> Column:
    """Twice the base at least while health is yellow or red; the base again after three successes in green."""
    return F.when(health_.isin("yellow", "red"), F.greatest(interval, base * 2)).when((health_ == "green") & (streak >= 3), base).otherwise(interval)


def cache_seconds(kinds: Column) -> Column:
    """Seconds for which results of these kinds may be cached: that of the most urgent; of a day's news for none or unknown ones."""
    known = F.transform(kinds, lambda k: mapping(k, CACHE_SECONDS, None).cast("int"))
    return F.coalesce(F.array_min(known), F.lit(CACHE_SECONDS["daily"]))


def candidate_limit(limit: Column) -> Column:
    return F.greatest(F.lit(30), F.least(F.lit(100), limit * 5)).cast("int")


def needs_correction(cited: Column, unsupported: Column, groundedness: Column, floor: float = 0.45) -> Column:
    return ~cited | unsupported | (groundedness < floor)


def quality_key(cited: Column, unsupported: Column, groundedness: Column, label: Column) -> Column:
    """Answers compare by this: valid citations, no unsupported claim, groundedness, confidence."""
    return F.struct(cited.cast("int").alias("a"), (~unsupported).cast("int").alias("b"), groundedness.alias("c"), mapping(label, {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "TOP": 3}, 0).cast("int").alias("d"))
