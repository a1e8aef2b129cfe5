"""Text to rows: weights, rules, relative deadlines and facts in outlines and announcements, line by line with built-in regexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.state import let
from ..functions.text import fnv1a, outline_type

#: Line patterns (fixed values). Each is tried on a trimmed line.
WEIGHT_LINE = r"^(.*?[A-Za-z)])[ .:|-]*\(?([0-9]+(?:\.[0-9]+)?) ?%\)?"
TIMES_LINE = r"^(.*?[A-Za-z])[ .:|-]*([0-9]+) ?[xX×] ?([0-9]+(?:\.[0-9]+)?) ?%"
BEST_OF = r"(?i)best ([0-9]+) (?:of|out of) ([0-9]+)"
DROP_LOWEST = r"(?i)drop(?:ping|ped)?(?: the)? lowest ?([0-9]*)"
RELATIVE = r"(?i)([0-9]{1,3}) days? after (?:the |each |your )?(lab|lecture|tutorial|seminar)"
#: Facts of posts, over text whose runs of blanks are one space. (item)(number)(phrase); a gap doesn't run into the next item with a number.
_WORK = r"(?:assignment|quiz|lab|midterm|mid[- ]term|project|final exam|exam|homework|hw|test|a(?= ?#?[0-9])|q(?= ?#?[0-9]))"
_GAP = r"(?:(?!\b(?:" + _WORK + r" ?#?[0-9]|midterm|mid[- ]term|final exam|project))[^.!?])"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
MOVED_DAY = rf"(?i)\b({_WORK}) ?#?([0-9]*)({_GAP}{{0,40}}?(?:due|moved|extended|postponed|rescheduled){_GAP}{{0,30}}?)({_DAY})"
MOVED_LABEL = rf"(?i)\b({_WORK}) ?#?([0-9]*)({_GAP}{{0,40}}?\b(?:(?:due|deadline) (?:date )?(?:is |was |has been )?(?:extended|postponed|moved|changed)|extended? (?:to|until)|new due date)\b[: ]+)((?!{_GAP}*?{_DAY}){_GAP}{{3,80}})"
CANCELLED = r"(?i)\b(lecture|lab|class|tutorial|assignment|quiz|midterm|mid[- ]term)(?:zes|e?s)? ?#?([0-9]*)(?![a-z])(?=[^.!?;]{0,40}?\b(?:cancel|will not (?:meet|be held)|no class\b))"
LOCATION = r"\b((?i:midterm|mid[- ]term|final|exam|quiz|test|lecture)) ?#?([0-9]*)[^.!?]{0,30}?\b(?i:in|at|room|location) (?:(?i:room) )?([A-Z]{1,6} ?[0-9]{2,5}[A-Z]?\b|[A-Za-z]+ Hall [0-9]+)"
EXAM = r"(?i)\b(?:mid[- ]?term|final exam|exam date)\b"
EXAM_HINT = r"(?i)\b(mid[- ]?term|final(?: exam)?)\b"
EXAM_DAY = rf"(?i)\b(?:mid[- ]?term|final(?: exam)?)\b[^.!?]{{0,40}}?\b({_DAY}|{_MONTH} [0-9]{{1,2}}(?:,? ?[0-9]{{4}})?|[0-9]{{1,2}}/[0-9]{{1,2}}(?:/[0-9]{{2,4}})?)"
GRADES_OUT = r"(?i)\b(?:grades? (?:are|have been|posted|released)|feedback (?:is|has been) (?:posted|available))\b"
RESOURCE = r"(?i)\b(?:posted|uploaded|attached|see (?:the )?(?:pdf|document|slides|handout))\b"
SCHEDULE = r"(?i)\b(?:schedule|week [0-9]+|moved to|class will)\b"
ASSESSMENT = r"(?i)\b((?:assignment|quiz|lab|project|mid[- ]?term|final(?: exam)?|homework|hw|test) ?#? ?[0-9]*[a-z]?|[aq] ?[0-9]+)\b"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no and line of all lines that aren't blank; two-column lines (with ||) count as two."""
    parts = F.split(F.col(text_col), r"\n|\|\|")
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("line_no", "line"))
    return out.withColumn("line", F.trim(F.regexp_replace("line", r"[ \t\r\x{A0}]+", " "))).filter("line <> ''")


def weight_rows(of_lines: DataFrame) -> DataFrame:
    """Items with a weight: title, type, count and weight each (3 x 15% gives three of 15). A line without a title before its number is left out."""
    g = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    times = F.col("line").rlike(TIMES_LINE)
    title = F.trim(F.when(times, g(TIMES_LINE, 1)).otherwise(g(WEIGHT_LINE, 1)))
    count = F.when(times, g(TIMES_LINE, 2)).otherwise("1").cast("int")
    weight = F.when(times, g(TIMES_LINE, 3)).otherwise(g(WEIGHT_LINE, 2)).cast("double")
    out = of_lines.select("doc_id", "line_no", title.alias("title"), count.alias("count"), weight.alias("weight")).filter("title IS NOT NULL AND weight <= 100")
    return out.withColumn("type", outline_type(F.col("title")))


def rules(of_lines: DataFrame) -> DataFrame:
    """Grading rules: BestN (n, of), DropLowest (n) and RelativeDeadline (n days after a kind of meeting)."""
    g = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    rule = lambda p, kind, n, of, anchor: F.when(F.col("line").rlike(p), F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), of.cast("int").alias("of"), anchor.alias("anchor")))
    none = F.lit(None).cast("string")
    found = F.array(
        rule(BEST_OF, "BestN", g(BEST_OF, 1), g(BEST_OF, 2), none),
        rule(DROP_LOWEST, "DropLowest", F.coalesce(g(DROP_LOWEST, 1), F.lit("1")), none, none),
        rule(RELATIVE, "RelativeDeadline", g(RELATIVE, 1), none, F.lower(g(RELATIVE, 2))),
    )
    return of_lines.select("doc_id", "line_no", F.explode(F.array_compact(found)).alias("r")).select("doc_id", "line_no", "r.*")


def _iso_day(label: Column) -> Column:
    """yyyy-MM-dd of a label that names a day with its year; else null, since the year is not guessed."""
    month = rf"(?i)\b({_MONTH}) ([0-9]{{1,2}})(?:st|nd|rd|th)?,? ?([0-9]{{4}})"
    g = lambda k: F.regexp_extract(label, month, k)
    named = F.when(label.rlike(month), F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.left(g(1), F.lit(3))), g(2), g(3)), F.lit("MMM d yyyy")))
    return let(F.regexp_extract(label, _DAY, 0), lambda day: F.coalesce(F.when(day != "", day), F.date_format(named, "yyyy-MM-dd")))


def announcement_facts(posts: DataFrame, id_col: str = "post_id", text_col: str = "text") -> DataFrame:
    """Facts that a post states: post_id, kind, hint, value, confidence; staff_only posts and a title before the text are up to the caller.

    Kinds: due_changed and extension (value: the new day, or its label at less confidence), cancelled and location (value: the room), as many
    as the post has; exam (value: its day or label), grade_release, resource, schedule (not beside cancelled), once each; clarification where
    there is nothing else but an item."""
    blank = lambda c: let(c, lambda c: F.when(c != "", c))
    none = F.lit(None).cast("string")
    fact = lambda kind, hint, value, sure: F.struct(kind.alias("kind"), hint.alias("hint"), value.alias("value"), sure.cast("double").alias("confidence"))
    item = lambda m: F.trim(F.concat_ws(" ", F.lower(m["1"]), m["2"]))

    def moved(m: Column) -> Column:
        label = F.regexp_replace(m["4"], r"(?i)^(?:to|until) |[ ,;]+(?:(?:and|but)(?: the)?)? *$", "")
        kind = F.when(F.concat(m["3"], m["4"]).rlike("(?i)extend|postpon"), "extension").otherwise("due_changed")
        told = lambda label, day: fact(kind, item(m), F.coalesce(day, label), F.when(day.isNotNull(), 0.75).otherwise(0.55))
        return let(label, lambda label: let(_iso_day(label), lambda day: told(label, day)))

    def stated(body: Column) -> Column:
        def each(p: str, groups: int, made) -> Column:
            """A fact of every match of p; its groups are looked for only where it matches."""
            matches = F.transform(F.arrays_zip(*(F.regexp_extract_all(body, F.lit(p), F.lit(k)).alias(str(k)) for k in range(1, groups + 1))), made)
            return F.when(body.rlike(p), matches)

        def once(p: str, kind: str, hint: Column, value: Column, sure: Column) -> Column:
            return F.when(body.rlike(p), F.array(fact(F.lit(kind), hint, value, sure)))

        def exam() -> Column:
            hint = F.coalesce(blank(F.lower(F.regexp_extract(body, EXAM_HINT, 1))), F.lit("exam"))
            told = lambda label, day: once(EXAM, "exam", hint, F.coalesce(day, label), F.when(day.isNotNull(), 0.7).otherwise(0.45))
            return F.when(body.rlike(EXAM), let(blank(F.regexp_extract(body, EXAM_DAY, 1)), lambda label: let(_iso_day(label), lambda day: told(label, day))))

        def facts(first: Column, cancelled: Column) -> Column:
            parts = [
                each(MOVED_DAY, 4, moved),
                each(MOVED_LABEL, 4, moved),
                cancelled,
                each(LOCATION, 3, lambda m: fact(F.lit("location"), item(m), m["3"], F.lit(0.65))),
                exam(),
                once(GRADES_OUT, "grade_release", first, none, F.lit(0.6)),
                once(RESOURCE, "resource", first, none, F.lit(0.4)),
                F.when(cancelled.isNull() & body.isNotNull(), once(SCHEDULE, "schedule", none, none, F.lit(0.4))),
            ]
            other = F.when(first.isNotNull(), F.array(fact(F.lit("clarification"), first, none, F.lit(0.35))))
            return let(F.flatten(F.array_compact(F.array(*parts))), lambda found: F.when(F.size(found) > 0, found).otherwise(other))

        first = blank(F.trim(F.lower(F.regexp_extract(body, ASSESSMENT, 1))))
        cancelled = each(CANCELLED, 2, lambda m: fact(F.lit("cancelled"), item(m), none, F.lit(0.7)))
        return let(first, lambda first: let(cancelled, lambda cancelled: facts(first, cancelled)))

    body = F.trim(F.regexp_replace(F.col(text_col), r"[ \t\r\n\x{A0}]+", " "))
    return posts.select(F.col(id_col).alias("post_id"), F.inline(let(body, stated)))


#: "Quiz 2 ... is due: Monday" in an announcement (fixed values), and how many such phrases of one are taken.
ANNOUNCED = r"(?i)\b((?:assignment|quiz|lab|project|mid[- ]?term|final(?:\s+exam)?|homework|hw)\s*#?\s*[0-9]*|a\s*[0-9]+|q\s*[0-9]+)\b[^.!?]{0,60}?\b(?:due|deadline)\b[:\s]+([^.!?]{3,60})"
ANNOUNCED_MOST = 5


def announced(posts: DataFrame) -> DataFrame:
    """Items that a post says are due: post_id, number (from 0), title and label, as the post has them; hidden posts and null texts have none.

    posts: post_id, text, hidden."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    g = lambda k: F.regexp_extract_all(flat, F.lit(ANNOUNCED), F.lit(k))
    found = posts.filter(~F.coalesce("hidden", F.lit(False))).select("post_id", F.posexplode(F.slice(F.arrays_zip(g(1).alias("title"), g(2).alias("label")), 1, ANNOUNCED_MOST)).alias("number", "m"))
    return found.select("post_id", "number", F.trim(F.regexp_replace("m.title", r"\s+", " ")).alias("title"), F.trim("m.label").alias("label"))


def fingerprints(outlines: DataFrame, instances: DataFrame, categories: DataFrame, deadlines: DataFrame) -> DataFrame:
    """course_id and fingerprint: a hash of what an outline means, whatever its headers and pages.

    outlines: course_id, code, term; the others: course_id, ord and line (an instance, category or relative deadline as text). Equal lines in
    equal order give equal hashes; an outline's lines are one text, as long as its outline."""
    parts = outlines.select("course_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat_ws("::", F.coalesce("code", F.lit("")), F.coalesce("term", F.lit(""))).alias("line"))
    for n, rows in enumerate((instances, categories, deadlines), 1):
        parts = parts.unionByName(rows.select("course_id", F.lit(n).alias("part"), F.col("ord").cast("long").alias("ord"), "line"))
    lines = F.array_sort(F.collect_list(F.struct("part", "ord", "line")))
    joined = parts.groupBy("course_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "::").alias("text"))
    return joined.join(outlines.select("course_id"), "course_id", "left_semi").select("course_id", F.lower(F.hex(fnv1a(F.col("text")))).alias("fingerprint"))
