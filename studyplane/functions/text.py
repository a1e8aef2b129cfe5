"""Column expressions over text: title keys, type ladders, matching tokens, content hashes, search scores, redaction.

Word bounds are spelled out as ASCII classes, so that accented letters behave alike everywhere."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from .state import filled, let

#: A word's bound between ASCII letters, digits and underscores, where \b would count accented letters too.
_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: The same before what begins with such a character.
_BEFORE = r"(?<![A-Za-z0-9_])"


def _begins(rest: str) -> bool:
    """Whether what the rest of a pattern matches surely begins with an ASCII letter, digit or underscore."""
    if m := re.match(r"(?:[A-Za-z0-9_]|\\[dw])(?![?*]|\{[0,])", rest):
        return bool(m)
    group = re.match(r"\((?:\?:)?(?!\?)", rest)
    if not group:
        return False
    depth, in_class, at, parts = 0, False, group.end(), [group.end()]
    while at < len(rest) and (depth or in_class or rest[at] != ")"):
        c = rest[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(at + 1)
        at += 1
    return not re.match(r"[?*]|\{[0,]", rest[at + 1 :]) and all(_begins(rest[x:y]) for x, y in zip(parts, [p - 1 for p in parts[1:]] + [at]))


def bounded(pattern: str) -> str:
    r"""The pattern with \b as a bound of ASCII words, which looks only behind where a word's character is what must follow."""
    return re.sub(r"\\b", lambda m: _BEFORE if _begins(pattern[m.end() :]) else _BOUND, pattern)


@F.pandas_udf(BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    def one(p: str | None) -> bool:
        try:
            re.compile(p or "")
        except re.error:
            return False
        return True

    return patterns.map(one)


def title_pattern(pattern: Column) -> Column:
    r"""A title pattern as it is matched: in any case, its own escapes kept; one that isn't a regular expression stands for itself.

    Only rules are looked at so, before they meet items; null stays null."""
    return F.concat(F.lit("(?iu)"), F.when(_compiles(pattern), pattern).otherwise(F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))))


#: Ladders of (type, pattern) tried in order over lower-cased text (fixed values): of items of the system, and of outline lines.
TYPE_LADDER = (
    ("final", r"\bfinal\b"),
    ("midterm", r"\bmid[- ]?term\b"),
    ("lab", r"\blab\b"),
    ("project", r"\bproject\b"),
    ("presentation", r"\bpresentation\b"),
    ("participation", r"\bparticipation\b|\battendance\b"),
    ("discussion", r"\bdiscussion\b|\bforum\b"),
    ("quiz", r"\bquiz\b|\btest\b"),
    ("assignment", r"\bassign|\bhomework\b|\bhw\b"),
)
OUTLINE_TYPE_LADDER = (
    *TYPE_LADDER[:6],
    ("discussion", r"\bdiscussion\b"),
    ("quiz", r"\bquiz\b|\btest\b"),
    ("assignment", r"\bassign|\bhomework\b|\bhw\b|\bessay\b|\breport\b"),
)

#: Kinds of meetings by title, in order; else lecture (fixed values).
MEETING_LADDER = (
    ("office_hours", r"\boffice\s*hours\b"),
    ("lab", r"\blab\b"),
    ("tutorial", r"\btutorial|tut\b"),
    ("seminar", r"\bseminar\b"),
    ("lecture", r"\blecture|lec\b|class\b"),
)

#: Calendar titles that name deadlines, meetings and courses (fixed values).
DEADLINE_TITLE = r"\b(due|deadline|assignment|dropbox|submission|quiz|mid[- ]?term|final\s*exam|exam\b|test\b|homework|hw\b|a\d{1,2}\b)\b"
MEETING_TITLE = r"\b(lecture|lab|tutorial|seminar|class|lec\b|office\s*hours|discussion)\b"
COURSE_TITLE = r"\b(cis|engr|math|stat|phys|chem|biol|psyc|soc|hist|econ)\s*\*?\s*\d{3,4}\b"

#: Title rewrites for the key (fixed values), in order.
TITLE_KEY = (
    (r"(^|[^a-z0-9])assign(ment)?s?($|[^a-z0-9])", "$1assignment$3"),
    (r"(^|[^a-z0-9])(hw|homework)($|[^a-z0-9])", "$1assignment$3"),
    (r"(^|[^a-z0-9])a *#? *([0-9]+)($|[^a-z0-9])", "$1assignment $2$3"),
    (r"(^|[^a-z0-9])q *#? *([0-9]+)($|[^a-z0-9])", "$1quiz $2$3"),
    (r"[^a-z0-9]+", " "),
)

#: More rewrites for the matching tokens (fixed values), before those of the key's numbers.
SYNONYMS = (
    (r"quizzes", "quiz"),
    (r"laborator(y|ies)", "lab"),
    (r"mid[ -]?terms?", "midterm"),
    (r"final +exam(ination)?s?", "final"),
    (r"(^|[^a-z0-9])l *#? *([0-9]+)($|[^a-z0-9])", "$1lab $2$3"),
    (r"(^|[^a-z0-9])p *#? *([0-9]+)($|[^a-z0-9])", "$1project $2$3"),
)

#: Where a title's number stands, in order of preference (fixed values).
NUMBER_HINTS = (
    r"(?:^|[^a-z0-9])(?:assignment|quiz|lab|project|homework|hw) *#? *([0-9]+)",
    r"(?:^|[^a-z0-9])[aqhlp] *#? *([0-9]+)(?:$|[^a-z0-9])",
    r"# *([0-9]+)",
    r"(?:^|[^a-z0-9])([0-9]+)(?:$|[^a-z0-9])",
)

#: What may match what, from the left to the right (fixed values; not symmetric).
COMPATIBLE = {
    "assignment": ("assignment", "project", "other"),
    "quiz": ("quiz", "other"),
    "lab": ("lab", "assignment", "other"),
    "project": ("project", "assignment", "other"),
    "midterm": ("midterm", "quiz", "other"),
    "final": ("final", "other"),
    "participation": ("participation", "other"),
    "presentation": ("presentation", "other"),
    "discussion": ("discussion", "other"),
    "other": ("other", "assignment", "quiz", "lab", "project"),
}


def rewritten(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def title_key(title: Column) -> Column:
    """Lower-cased title with its kind spelled out, only letters, digits and single blanks."""
    return F.trim(rewritten(F.lower(title), TITLE_KEY))


def key_tokens(key: Column) -> Column:
    """Distinct tokens of a title's key longer than one character."""
    return F.filter(F.array_distinct(F.split(key, " ")), lambda t: F.length(t) > 1)


def title_tokens(title: Column) -> Column:
    """Distinct tokens of the key longer than one character."""
    return key_tokens(title_key(title))


def canonical_tokens(title: Column) -> Column:
    """Distinct tokens after the wider synonyms."""
    return F.filter(F.array_distinct(F.split(F.trim(rewritten(F.lower(title), SYNONYMS + TITLE_KEY)), " ")), lambda t: F.length(t) > 0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def number_hint(title: Column) -> Column:
    low = F.lower(title)
    return F.coalesce(*(F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in NUMBER_HINTS))


def ladder(text: Column, steps: Sequence[tuple[str, str]], default: str | Column) -> Column:
    """The first name whose pattern is found in the text, else the default."""
    out = F.lit(default) if isinstance(default, str) else default
    for name, pattern in reversed(steps):
        out = F.when(text.rlike(bounded(pattern)), name).otherwise(out)
    return out


def title_type(title: Column, default: str | Column = "other") -> Column:
    """The type that a title names, else the default."""
    return ladder(F.lower(title), TYPE_LADDER, default)


def outline_type(title: Column) -> Column:
    """The type of an item named in an outline."""
    return let(F.lower(title), lambda low: ladder(low, OUTLINE_TYPE_LADDER, "other"))


def meeting_kind(title: Column) -> Column:
    return ladder(F.lower(title), MEETING_LADDER, "lecture")


def is_schedule_title(title: Column) -> Column:
    """Whether a calendar title names a meeting: meeting words win over deadline words; a course code counts where neither is there."""
    t = F.lower(F.trim(title))
    meets, due = t.rlike(bounded(MEETING_TITLE)), t.rlike(bounded(DEADLINE_TITLE))
    return F.coalesce((t != "") & (meets | (~due & t.rlike(bounded(COURSE_TITLE)))), F.lit(False))


def is_deadline_title(title: Column) -> Column:
    t = F.lower(F.trim(title))
    return F.coalesce((t != "") & ~is_schedule_title(title) & t.rlike(bounded(DEADLINE_TITLE)), F.lit(False))


def course_key(code: Column) -> Column:
    """c and the four digits of a course code, else its first twelve letters and digits."""
    digits = F.regexp_extract(F.regexp_replace(code, r"\s", ""), r"[A-Za-z]+\*?(\d{4})", 1)
    return F.when(digits != "", F.concat(F.lit("c"), digits)).otherwise(F.left(F.lower(F.regexp_replace(code, "[^A-Za-z0-9]", "")), F.lit(12)))


def week_hint(module: Column, title: Column) -> Column:
    """Week n where the module's or the item's title names a week."""
    n = F.regexp_extract(F.lower(F.concat_ws(" ", module, title)), bounded(r"\bweek\s*(\d{1,2})\b"), 1)
    return F.when(n != "", F.concat(F.lit("Week "), n))


#: Codes of buildings before a room's number (fixed values).
BUILDINGS = "RICH SSC MACN MACK ROZH THRN ANNU CRSC SCI WMEM UC LA"


def location_of(description: Column) -> Column:
    """The room that a description names, else its first 48 characters; null if it has none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(description, "<[^>]+>", " "), r"\s+", " "))
    room = F.regexp_extract(F.upper(plain), bounded(r"\b((?:" + "|".join(BUILDINGS.split()) + r")\s*\d{2,4}[A-Z]?)\b"), 1)
    return F.when(room != "", room).when(plain != "", F.trim(F.left(plain, F.lit(48))))


def first_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0), F.lit(""))


def title_score(a: Column, b: Column) -> Column:
    """100 for equal title keys, 75 if one holds the other, else 0; 0 for a title without a key."""
    x, y = title_key(a), title_key(b)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0).when(x == y, 100).when(x.contains(y) | y.contains(x), 75).otherwise(0)


def category_expansion(title: Column, weight: Column) -> Column:
    """What a category's title says of its items, as a struct: count, instance_weight, best_n, drop_lowest.

    4 x 5% gives both; (4) gives the count, which shares the weight; best 5 of 7 gives the count, best_n and the two to drop."""
    low = F.lower(title)
    g = lambda p, k: F.nullif(F.regexp_extract(low, bounded(p), k), F.lit(""))
    times = r"(\d+) *[x×] *(\d+(?:\.\d+)?) *%"
    listed = F.coalesce(g(r"\( *(\d+) *\)", 1), F.lit(None)).cast("int")
    best, total = g(r"\bbest *(\d+)(?: *(?:out +)?of *(\d+))?", 1).cast("int"), g(r"\bbest *(\d+)(?: *(?:out +)?of *(\d+))?", 2).cast("int")
    count = F.coalesce(total, listed, g(times, 1).cast("int"))
    each = F.when(listed > 0, F.coalesce(weight / listed, g(times, 2).cast("double"))).otherwise(g(times, 2).cast("double"))
    return F.struct(count.alias("count"), each.alias("instance_weight"), best.alias("best_n"), F.when(count > best, count - best).otherwise(0).alias("drop_lowest"))


def line_diff(before: Column, after: Column, most: int = 12) -> Column:
    """Lines that differ place by place, `- ` for the old and `+ ` for the new one, each cut to 120 characters.

    A place is still shown while fewer than `most` lines were, so a pair may end one line beyond."""
    lines = lambda c: F.split(c, "\r?\n")
    cut = lambda mark, c: F.concat(F.lit(mark), F.left(c, F.lit(120)))
    pairs = F.zip_with(lines(before), lines(after), lambda a, b: F.when(~a.eqNullSafe(b), F.array_compact(F.array(F.when(a.isNotNull(), cut("- ", a)), F.when(b.isNotNull(), cut("+ ", b))))).otherwise(F.array().cast("array<string>")))
    shown = F.aggregate(pairs, F.array().cast("array<string>"), lambda got, p: F.when(F.size(got) < most, F.concat(got, p)).otherwise(got))
    return F.array_join(shown, "\n")


def compatible(a: Column, b: Column) -> Column:
    pairs = F.create_map(*(x for k, v in COMPATIBLE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return (a == b) | F.coalesce(F.array_contains(F.try_element_at(pairs, a), b), F.lit(False))


def match_features(title: Column) -> dict[str, Column]:
    """What matching needs of a title, to be made once a row: key, tokens and wide (both sorted), hint."""
    return {"title_key": title_key(title), "tokens": F.array_sort(title_tokens(title)), "wide": F.array_sort(canonical_tokens(title)), "hint": number_hint(title)}


def match_score(a: str, b: str) -> Column:
    """0 to 1: how likely rows a and b (aliases with match_features, type and due) of one course are the same item. Not symmetric."""
    x = lambda n: F.col(f"{a}.{n}")
    y = lambda n: F.col(f"{b}.{n}")
    base = F.greatest(jaccard(x("tokens"), y("tokens")), jaccard(x("wide"), y("wide")))
    days = F.abs(F.unix_micros(x("due")) - F.unix_micros(y("due"))) / 864e8
    near = F.when(days <= 3, 0.15).when(days > 21, -0.2).otherwise(0.0)
    scored = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(x("hint") == y("hint"), 0.25).otherwise(0.0) + near))
    return F.when(x("title_key") == y("title_key"), 0.98).when(~compatible(x("type"), y("type")) | F.coalesce(x("hint") != y("hint"), F.lit(False)), 0.0).otherwise(scored)


#: The hash's start and factor (fixed values), and how few texts are left when a batch's last ones are stepped through one by one.
FNV_START, FNV_FACTOR, FEW = 2166136261, 16777619, 16


@F.pandas_udf(LongType())
def _fnv1a(texts: pd.Series) -> pd.Series:
    """Steps through the code units of all texts of a batch at once, the longest first, so that those still running are a prefix."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts.fillna("")]
    size = np.array([len(u) for u in units], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([units[i] for i in order] or [np.empty(0, "<u2")]).astype(np.uint32)
    starts = np.cumsum(size) - size
    h = np.full(len(size), FNV_START, dtype=np.uint32)
    steps = int(size[FEW]) if len(size) > FEW else 0
    running = np.searchsorted(-size, -np.arange(steps), side="left")  # texts longer than a step
    for i in range(steps):
        k = running[i]
        h[:k] = (h[:k] ^ flat[starts[:k] + i]) * np.uint32(FNV_FACTOR)
    for j in range(min(FEW, len(size))):
        x = int(h[j])
        for u in flat[starts[j] + min(steps, size[j]) : starts[j] + size[j]].tolist():
            x = (x ^ u) * FNV_FACTOR & 0xFFFFFFFF
        h[j] = x
    out = np.empty(len(size), dtype=np.int64)
    out[order] = h
    return pd.Series(out)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 units, as a long; null for null. Code points beyond the basic plane count as their two surrogates."""
    return F.when(text.isNotNull(), _fnv1a(text))


def content_hash(text: Column) -> Column:
    """fnv_, eight hex digits, _ and the length in UTF-16 units; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    return F.concat(F.lit("fnv_"), F.lpad(F.lower(F.hex(fnv1a(text))), 8, "0"), F.lit("_"), units.cast("long").cast("string"))


def searchable(*fields: Column) -> Column:
    """The fields that aren't empty, lower-cased, white space collapsed."""
    parts = F.filter(F.array(*fields), filled)
    return F.trim(F.regexp_replace(F.lower(F.array_join(parts, " · ")), r"[ \t\r\n]+", " "))


def search_score(query: str, hay: Column) -> Column:
    """40 for the phrase, then 12 for each word the text begins with and 8 for each it has; 0 if a word is missing."""
    words = query.lower().split()
    if not words:
        return F.lit(0)
    score = F.when(hay.contains(" ".join(words)), 40).otherwise(0)
    for w in words:
        score = score + F.when(hay.startswith(w), 12).otherwise(8)
    every = hay.contains(words[0])
    for w in words[1:]:
        every = every & hay.contains(w)
    return F.when(every, score).otherwise(0)


def snippet(body: Column, query: str, radius: int = 60, fallback: int = 120) -> Column:
    """The text around the first word of the query, with ellipses where it was cut; else its beginning."""
    word = (query.lower().split() or [""])[0]
    flat = F.trim(F.regexp_replace(body, r"[ \t\r\n]+", " "))
    at = F.locate(word, F.lower(flat))
    begin = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(flat), at + len(word) - 1 + radius)
    cut = F.concat(F.when(begin > 1, "…").otherwise(""), F.substring(flat, begin, end - begin + 1), F.when(end < F.length(flat), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.left(flat, F.lit(fallback)))


#: HTML to plain text (fixed values): scripts and styles go, block tags end lines, other tags are blanks.
HTML_STEPS = (
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "),
    (r"(?i)</?(p|div|br|li|tr|h[1-6]|ul|ol|table|section|article)[^>]*>", "\n"),
    (r"<[^>]+>", " "),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"[ \t\r]+", " "),
    (r" ?\n[ \n]*", "\n"),
)


def html_to_text(page: Column) -> Column:
    return F.trim(rewritten(page, HTML_STEPS))


#: Marks of masked text, and the patterns of secrets, addresses and labelled numbers (fixed values), in order.
REDACTED, REDACTED_EMAIL, REDACTED_NAME, REDACTED_ID = "[redacted]", "[email]", "[user-name]", "[student-id]"
SECRETS = r"(?i)\b(access_token|refresh_token|id_token|token|sessionid|session_id|d2lSessionVal|d2lSecureSessionVal|password)=([^&\s\"']+)"
EMAILS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LABELLED_IDS = r"(?i)\b(student\s*(?:id|number|no\.?|#)|id\s*(?:number|no\.?))(\s*[:#-]?\s*)\d{6,10}\b"


def redacted(text: Column, name: str | None = None, ids: Sequence[str] = ()) -> Column:
    """Text without secrets, addresses, the user's name and ids, and labelled student numbers, masked in this order.

    The name goes in full and as last, first in any case, and word by word where it is capitalised."""
    quoted = lambda x: re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", x)
    steps = [(bounded(SECRETS), f"$1={REDACTED}"), (EMAILS, REDACTED_EMAIL)]
    full = (name or "").strip()
    if len(full) >= 2:
        parts = [p for p in full.split() if len(p) >= 3]
        steps.append((f"(?i){quoted(full)}", REDACTED_NAME))
        if len(parts) >= 2:
            steps.append((rf"(?i){quoted(parts[-1])},\s*{quoted(parts[0])}", REDACTED_NAME))
        steps += [(bounded(rf"\b{quoted(p)}\b"), REDACTED_NAME) for p in parts if "A" <= p[0] <= "Z"]
    steps += [(rf"(?<![A-Za-z0-9_]){quoted(i.strip())}(?![A-Za-z0-9_])", REDACTED_ID) for i in ids if len(i.strip()) >= 3]
    return rewritten(text, [*steps, (bounded(LABELLED_IDS), f"$1$2{REDACTED_ID}")])


def endpoint_template(url: Column) -> Column:
    """A URL's path with numbers as {id}, versions as {v}, no origin, and query keys without values."""
    return rewritten(url, ((r"^https?://[^/]+", ""), (r"#.*$", ""), (r"=[^&]*", ""), (r"/[0-9]+\.[0-9]+(/|$)", "/{v}$1"), (r"[0-9]+", "{id}")))


#: Document classes over the lower-cased title, module, headings and body, in order (fixed values); exam_information not beside practice.
DOCUMENT_LADDER = (
    ("course_outline", r"outline|syllabus|course\s*outline"),
    ("grading_rubric", r"rubric"),
    ("grading_scheme", r"grading\s*scheme|grade\s*scheme|weighting"),
    ("policy", r"late\s*policy|academic\s*integrity|policy|accommodation"),
    ("faq", r"\bfaq\b|frequently\s+asked"),
    ("exam_information", r"exam|mid[- ]?term|final\s+exam|test\s+info"),
    ("course_schedule", r"schedule|weekly\s+schedule|course\s+calendar"),
    ("starter_code_metadata", r"starter|skeleton|template\s*code|\.zip|\.tar"),
    ("lab_instructions", r"\blab\b|laboratory"),
    ("tutorial", r"tutorial|tut\s*\d"),
    ("assignment_specification", r"assignment|a\s*\d+|homework|\bhw\b|specification|spec\b"),
    ("lecture_slides", r"slides|powerpoint|\.pptx|\.ppt"),
    ("lecture_notes", r"lecture|notes|handout"),
    ("reading", r"reading|chapter|textbook|article"),
    ("reference", r"reference|cheatsheet|cheat\s*sheet|appendix"),
    ("syllabus_addendum", r"addendum|errata"),
)


def document_class(title: Column, body: Column | None = None, mime: Column | None = None, *more: Column) -> Column:
    """The class of a document by its title, the first 400 characters of its body, its type, and more context such as the module."""
    none = F.lit("")
    context = F.lower(F.concat_ws(" ", title, *more, F.left(F.coalesce(none if body is None else body, none), F.lit(400))))
    kind = F.lower(F.coalesce(none if mime is None else mime, none))
    out = F.lit("unknown")
    for name, pattern in reversed(DOCUMENT_LADDER):
        found = context.rlike(bounded(pattern))
        if name == "exam_information":
            found = found & ~context.contains("practice")
        elif name == "starter_code_metadata":
            found = found | kind.contains("application/zip")
        elif name == "lecture_slides":
            found = found | kind.contains("presentation")
        out = F.when(found, name).otherwise(out)
    return out


#: Points of a body that reads like a course outline, and of one that doesn't (fixed values).
OUTLINE_POINTS = (
    (r"\b(evaluation|grading|assessment|marking scheme|grade breakdown)\b", 25),
    (r"\b(mid[- ]?term|final\s+exam)\b", 15),
    (r"\b(instructor|professor)\b", 10),
    (r"\b(best\s*\d+|drop\s*(the\s+)?lowest)\b", 12),
    (r"\b(syllabus|course\s*outline)\b", 10),
    (r"\blecture\s*\d+|assignment\s*solution|answer\s*key\b", -20),
)


def outline_score(body: Column) -> Column:
    """The points of a body; 30 more for three percentages."""
    low = F.lower(body)
    score = F.when(F.regexp_count(low, F.lit(r"\d{1,3}\s*%")) >= 3, 30).otherwise(0)
    for pattern, n in OUTLINE_POINTS:
        score = score + F.when(low.rlike(bounded(pattern)), n).otherwise(0)
    return score


#: Names and endings of outline files (fixed values).
OUTLINE_NAME = r"\b(course[\s_-]*outline|syllabus|course\s*info(?:rmation)?|welcome\s*package|course\s*overview|grading\s*scheme|evaluation\s*scheme|assessment\s*overview)\b"
WEAK_OUTLINE = r"\b(outline|overview|introduction|welcome|policies|expectations)\b"
OUTLINE_FILE = r"\.(pdf|txt|html?|htm|rtf|md)(\?|$)"
CODE_AND_TERM = r"\b[a-z]{2,5}\s*[*_-]?\s*\d{4}\s*[-_]?\s*(f|w|s|fall|winter|summer)?\s*[-_]?\s*\d{2,4}\b|\b[a-z]{2,5}\d{4}[-_][fws]\d{2}\b"


def candidate_score(title: Column, url: Column, parent: Column) -> Column:
    """How much a topic looks like a course outline, by its title, address and parent's title."""
    none = F.lit("")
    above = F.lower(F.coalesce(parent, none))
    hay = F.concat_ws(" ", above, F.lower(F.coalesce(title, none)), F.lower(F.coalesce(url, none)))
    has = lambda c, p: c.rlike(bounded(p))
    named, weak, file = has(hay, OUTLINE_NAME), has(hay, WEAK_OUTLINE), has(hay, OUTLINE_FILE)
    above_named, above_weak, coded = has(above, OUTLINE_NAME), has(above, WEAK_OUTLINE), has(hay, CODE_AND_TERM)
    points = (
        (named, 50),
        (has(hay, r"\bcourse[\s_-]*outline\b"), 30),
        (hay.contains("syllabus"), 20),
        (hay.contains("outline") & ~named, 15),
        (weak & ~named, 12),
        (above_named, 35),
        (above_weak, 15),
        (file, 10),
        (has(hay, r"\.pdf(\?|$)"), 8),
        (has(hay, r"\.(docx?|pptx?|zip)(\?|$)"), -30),
        (has(hay, r"lecture|week\s*\d|assignment\s*\d|lab\s*\d|quiz\s*\d|chapter\s*\d"), -25),
        (has(hay, r"\b(rubric|solution|answer\s*key|sample)\b"), -20),
        (coded & file, 28),
        (coded & above_weak, 15),
        (above_named & has(hay, r"lecture|week\s*\d"), 15),
    )
    return sum((F.when(c, n).otherwise(0) for c, n in points[1:]), F.when(points[0][0], points[0][1]).otherwise(0))


def author_role(name: Column, instructors: Column, tas: Column, staff: Column) -> Column:
    """instructor, ta or staff where the name and a listed one (arrays of names) hold each other, else by a title in the name, else
    student; unknown without a name."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    n = plain(name)
    listed = lambda names: F.coalesce(F.exists(names, lambda x: (F.length(plain(x)) >= 2) & (n.contains(plain(x)) | plain(x).contains(n))), F.lit(False))
    return (
        F.when(n.isNull() | (n == ""), "unknown")
        .when(listed(instructors), "instructor")
        .when(listed(tas), "ta")
        .when(listed(staff), "staff")
        .when(n.rlike(bounded(r"\b(prof|dr\.|instructor|lecturer)\b")), "instructor")
        .when(n.rlike(bounded(r"\b(t\.?a\.?|teaching\s+assistant)\b")), "ta")
        .otherwise("student")
    )
