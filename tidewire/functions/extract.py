"""Page extraction: candidates in order of trust, length guards, rules after extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions.dom import CONTROLS


def paragraphs(html: Column) -> Column:
    """Text of the page's paragraphs, one a line."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, T.html_text), lambda x: x != ""), "\n")


def block(html: Column, tag: str, class_: str) -> Column:
    """Text of the first block of one class."""
    return T.html_text(F.regexp_extract(html, rf'(?is)<{tag}\b[^>]*class="[^"]*\b{class_}\b[^"]*"[^>]*>(.*?)</{tag}>', 1))


def cascade(candidates: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """Text and status of the first candidate (text, least length, status) that is long enough; null and ``extraction_failed`` if none is."""
    ok = [F.char_length(F.coalesce(c, F.lit(""))) >= n for c, n, _ in candidates]
    text = F.coalesce(*(F.when(k, c) for k, (c, _, _) in zip(ok, candidates, strict=True)))
    status = F.coalesce(*(F.when(k, F.lit(s)) for k, (_, _, s) in zip(ok, candidates, strict=True)), F.lit("extraction_failed"))
    return text, status


def page_text(html: Column) -> tuple[Column, Column]:
    """Paragraphs of 200 letters and more, else all text of 100 and more."""
    return cascade([(paragraphs(html), 200, "ok"), (T.html_text(html), 100, "partial")])


def levels(found: Column) -> tuple[Column, Column, Column]:
    """Text, status and method from what ``dom.Extractor`` found: the site's own blocks (their least length is the site's), dense text of 200 letters, all running text of 100."""
    ok = [found["site"].isNotNull(), F.char_length(found["precise"]) >= 200, F.char_length(found["broad"]) >= 100]
    pick = lambda values, other: F.coalesce(*(F.when(k, v) for k, v in zip(ok, values, strict=True)), other)
    text = pick([found["site"], found["precise"], found["broad"]], F.lit(None).cast("string"))
    return text, pick([F.lit("ok"), F.lit("ok"), F.lit("partial")], F.lit("extraction_failed")), pick([F.lit("site"), F.lit("precision"), F.lit("recall")], F.lit("failed_all_levels"))


def short_safe(found: Column, least: int = 40, markers: tuple[str, ...] = CONTROLS) -> tuple[Column, Column]:
    """Text and status of an article from trusted blocks alone, short ones too: one block or more, ``least`` letters, no phrase of a page's controls; below 200 letters it is partial."""
    text = found["site"]
    good = F.coalesce((found["blocks"] >= 1) & (F.char_length(text) >= least) & (noise(text, tuple(m.lower() for m in markers)) == 0), F.lit(False))
    return F.when(good, text), F.when(~good, "extraction_failed").when(F.char_length(text) >= 200, "ok").otherwise("partial")


def turbo_or_page(turbo: Column, paragraph_blocks: Column, page: Column, least: Column) -> tuple[Column, Column, Column]:
    """Text, status and reason: the structured text where it is good, else the page's where that is much longer, else the structured one as partial."""
    reason = candidate_quality(turbo, least, paragraph_blocks)
    good, better = reason == "ok", fallback_is_better(page, turbo)
    return F.when(~good & better, page).otherwise(turbo), F.when(good | better, "ok").otherwise("partial"), reason


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules in order: strip_tail (pattern to the end), drop_lines_starting, drop_lines_matching, unescape."""

    def lines(t: Column, keep) -> Column:
        return F.array_join(F.filter(F.split(t, "\n"), keep), "\n")

    def step(t: Column, rule: tuple[str, str]) -> Column:
        kind, arg = rule
        if kind == "strip_tail":
            return F.regexp_replace(t, f"(?s)(?:{arg}).*$", "")
        if kind == "drop_lines_starting":
            return lines(t, lambda x: ~F.startswith(F.ltrim(x), F.lit(arg)))
        if kind == "drop_lines_matching":
            return lines(t, lambda x: ~x.rlike(arg))
        if kind == "unescape":
            return T.unescape(t)
        raise ValueError(f"no rule {kind!r}")

    return reduce(step, rules, text)


def without_title(text: Column, title: Column, lead: bool = False) -> Column:
    """The text without its first line where that is the title, and with ``lead`` without the line after it too (a page's own lead); null if nothing is left. Such texts lose blank lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    same = (F.size(lines) > 0) & (T.normal(F.get(lines, F.lit(0))) == T.normal(title)) & (T.normal(title) != "")
    return F.when(F.coalesce(same, F.lit(False)), F.nullif(F.trim(F.array_join(F.slice(lines, 3 if lead else 2, 1 << 30), "\n")), F.lit(""))).otherwise(text)


def noise(text: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers a text holds."""
    return reduce(lambda a, m: a + F.contains(F.lower(text), F.lit(m)).cast("int"), markers, F.lit(0))


def compared(current: Column, candidate: Column, markers: tuple[str, ...]) -> Column:
    """Lengths, line counts, their difference, and whether the candidate has less noise."""
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return F.struct(size(current).alias("length"), size(candidate).alias("candidate_length"), (size(candidate) - size(current)).alias("delta"), count(current).alias("lines"), count(candidate).alias("candidate_lines"), (noise(candidate, markers) < noise(current, markers)).alias("less_noise"))


def taxonomy(category: Column, table: dict[str, tuple[str, str]], default: tuple[str, str] = ("news", "daily")) -> tuple[Column, Column]:
    """Content type and information type of a source's category, with a default."""
    pick = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in table.items() for x in (c, v[k])]), F.lower(category)), F.lit(default[k]))
    return pick(0), pick(1)


def blocks(html: Column) -> Column:
    """A page's headings, paragraphs and images in order, as structs (kind, text, url); those without text or address are left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>|<p\b[^>]*>.*?</p>|<img\b[^>]*>"), F.lit(0))

    def made(x: Column) -> Column:
        kind = F.when(x.rlike("(?i)^<h"), "heading").when(x.rlike("(?i)^<p"), "paragraph").otherwise("image")
        address = F.nullif(T.unescape(F.regexp_extract(x, r"""(?is)\bsrc\s*=\s*["']([^"']*)""", 1)), F.lit(""))
        return F.struct(kind.alias("kind"), F.when(kind != "image", T.html_text(x)).alias("text"), F.when(kind == "image", address).alias("url"))

    return F.filter(F.transform(found, made), lambda b: F.coalesce(b["text"], b["url"], F.lit("")) != "")


def letters(text: Column) -> Column:
    """How many Latin or Cyrillic letters and digits a text has."""
    return F.char_length(F.regexp_replace(text, "[^0-9A-Za-zА-Яа-яЁё]+", ""))


def candidate_quality(text: Column, least: Column, paragraph_blocks: Column | None = None) -> Column:
    """``ok``, or why an extracted candidate is refused: its length, lines of substance, lines of signs alone, and (where stated) paragraphs among its blocks."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    made = F.when(F.char_length(F.coalesce(text, F.lit(""))) < least, "turbo_too_short").when(F.size(F.filter(lines, lambda x: letters(x) >= 40)) < 2, "not_enough_meaningful_paragraphs").when(F.exists(lines, lambda x: letters(x) == 0), "punctuation_only_paragraph")
    return (made.when(paragraph_blocks < 2, "not_enough_turbo_paragraph_blocks") if paragraph_blocks is not None else made).otherwise("ok")


def fallback_is_better(fallback: Column, current: Column) -> Column:
    """Whether a fallback's text is long by itself and much longer than the current one."""
    new, old = (F.char_length(F.coalesce(c, F.lit(""))) for c in (fallback, current))
    return (new >= 500) & (new >= F.greatest(old * 3, old + 400))


def summary(lead: Column, content: Column, most: int = 280) -> Column:
    """An article's lead, or the beginning of its content where that is empty."""
    return F.coalesce(F.nullif(lead, F.lit("")), F.substring(content, 1, most))
