"""Materials of items: what is linked or named like them, the first three of all sources, and weeks, lectures, labs and midterms of a schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled
from .linking import contained, shuffled

#: Classes of documents that name an item by its title, kinds of links that lead to materials, and how many an item shows (fixed values).
NAMING, EXAMS = ("assignment_specification", "lab_instructions", "lab_handout", "grading_rubric"), ("exam_information",)
LINK_KINDS = ("HAS_SPEC", "HAS_RUBRIC", "HAS_STARTER")
SHOWN, TITLE_HEAD, SNIPPET = 3, 12, 80

#: The sources in their order.
LIBRARY, CONTENT, LINKS, OUTLINE = range(4)


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"\s+", " ")


def _label(document_class: Column, name: Column) -> Column:
    return F.concat(F.replace(document_class, F.lit("_"), F.lit(" ")), F.lit(": "), name)


def _evidence(rows: DataFrame, source: int, text: Column) -> DataFrame:
    return rows.select("item_id", F.lit(source).alias("source"), F.col("ord").cast("long").alias("ord"), text.alias("text"))


def holding_all_words(items: DataFrame, texts: DataFrame) -> DataFrame:
    """course_id, key and hay of the pairs of distinct keys and texts of a course in which the text holds every word of the key that has two
    characters or more. A key without such words is in every text.

    A key looks only at the texts that hold the word of it which the fewest texts of its course hold."""
    words = F.filter(F.split("key", r"\s+"), lambda w: F.length(w) > 1)
    keys = items.filter("key IS NOT NULL").select("course_id", "key").distinct().withColumn("words", words)
    hays = texts.filter("hay IS NOT NULL").select("course_id", "hay").distinct()
    each = keys.select("course_id", "key", "words", F.explode(F.array_distinct("words")).alias("needle"))
    held = settled(contained(each.select("course_id", "needle"), hays))
    often = held.groupBy("course_id", "needle").agg(F.count("*").alias("often"))
    rarest = each.join(shuffled(often), ["course_id", "needle"], "left").groupBy("course_id", "key", "words").agg(F.min_by("needle", F.struct(F.coalesce("often", F.lit(0)), "needle")).alias("needle"))
    named = rarest.join(shuffled(held), ["course_id", "needle"]).filter(F.forall("words", lambda w: F.contains(F.col("hay"), w))).select("course_id", "key", "hay")
    return named.unionByName(keys.filter(F.size("words") == 0).join(shuffled(hays), "course_id").select("course_id", "key", "hay"))


def linked(items: DataFrame, library: DataFrame, content: DataFrame, links: DataFrame, outline: DataFrame, shown: int = SHOWN) -> DataFrame:
    """item_id, place (from 1) and text of each item's first `shown` distinct materials.

    items: item_id, course_id, title. library: course_id, item_id, document_class, filename, ord. content: content_id, course_id, item_id,
    document_class, title, ord. links: from_id, to_id, kind, label, ord. outline: course_id, title, snippet, ord.

    In order: library files of the item, or of a naming class whose name holds the head of its title without blanks; content of its course
    that belongs to it, or of a naming class that holds all words of its title; links to specifications, rubrics and starters, either way; the
    snippet of the first line of its course's outline whose title is within the item's. Case counts for nothing. Nulls match nothing; an
    outline line without a title names no item. An item's texts are brought down to their first places before they meet."""
    it = items.select("item_id", "course_id", title_key(F.col("title")).alias("key"))
    naming = F.col("document_class").isin(*NAMING)
    named = it.filter("key IS NOT NULL").withColumn("needle", F.replace(F.left("key", F.lit(TITLE_HEAD)), F.lit(" "), F.lit("")))
    files = library.withColumn("hay", F.lower("filename")).filter(naming & F.col("hay").isNotNull())
    files = files.groupBy("course_id", "hay", _label(F.col("document_class"), F.col("filename")).alias("text")).agg(F.min("ord").alias("ord"))
    by_name = named.join(shuffled(contained(named.select("course_id", "needle"), files.select("course_id", "hay"))), ["course_id", "needle"]).join(shuffled(files), ["course_id", "hay"])
    blank = named.filter("needle = ''").join(shuffled(files), "course_id")  # a title of blanks is in every name
    told = _label(F.col("document_class"), F.col("filename"))
    of_library = _evidence(library.filter("item_id IS NOT NULL"), LIBRARY, told).unionByName(_evidence(by_name, LIBRARY, F.col("text"))).unionByName(_evidence(blank, LIBRARY, F.col("text")))
    texts = content.withColumn("hay", F.lower("title")).filter(F.col("document_class").isin(*NAMING, *EXAMS) & F.col("hay").isNotNull())
    texts = settled(texts.groupBy("course_id", "hay", _label(F.col("document_class"), F.col("title")).alias("text")).agg(F.min("ord").alias("ord")))
    by_words = it.join(shuffled(holding_all_words(it, texts)), ["course_id", "key"]).join(shuffled(texts), ["course_id", "hay"])
    own = content.filter("item_id IS NOT NULL").join(shuffled(it.select("item_id", "course_id")), ["item_id", "course_id"])
    of_content = _evidence(own, CONTENT, _label(F.col("document_class"), F.col("title"))).unionByName(_evidence(by_words, CONTENT, F.col("text")))
    kinds = links.filter(F.col("kind").isin(*LINK_KINDS))
    both = kinds.select(F.col("from_id").alias("item_id"), F.col("to_id").alias("other"), "kind", "label", "ord").unionByName(kinds.filter("from_id <> to_id").select(F.col("to_id").alias("item_id"), F.col("from_id").alias("other"), "kind", "label", "ord"))
    of_links = _evidence(both, LINKS, F.concat(F.lower(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(": "), F.coalesce("label", F.col("other").cast("string"))))
    lines = outline.withColumn("needle", F.lower("title")).filter("needle <> ''").groupBy("course_id", "needle").agg(F.min_by(F.struct("ord", "snippet"), "ord").alias("first"))
    held = contained(lines.select("course_id", "needle"), it.select("course_id", F.col("key").alias("hay"))).join(shuffled(lines), ["course_id", "needle"])
    first = held.groupBy("course_id", F.col("hay").alias("key")).agg(F.min("first").alias("first"))
    snippets = it.join(shuffled(first), ["course_id", "key"]).select("item_id", F.col("first.ord").alias("ord"), F.nullif(F.col("first.snippet"), F.lit("")).alias("snippet"))
    of_outline = _evidence(snippets, OUTLINE, F.concat(F.lit("outline: "), F.left("snippet", F.lit(SNIPPET))))
    every = of_library.unionByName(of_content).unionByName(of_links.withColumn("item_id", F.col("item_id").try_cast(dict(it.dtypes)["item_id"]))).unionByName(of_outline).filter("text IS NOT NULL")
    distinct = every.groupBy("item_id", "text").agg(F.min(F.struct("source", "ord")).alias("at"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("at", "text"))
    best = distinct.withColumn("place", place).filter(F.col("place") <= shown)
    return best.join(shuffled(it.select("item_id")), "item_id", "left_semi").select("item_id", "place", "text")


def schedule_links(entities: DataFrame, midterms: DataFrame, items: DataFrame) -> DataFrame:
    """from_id, to_id, kind and confidence of the distinct links between weeks, lectures, labs and midterms of each course.

    entities: course_id, kind (week, lecture, lab, midterm, other), label, week; midterms: course_id, title (of a blueprint's instances); items:
    course_id, title, ord, item_id. A week (any entity with a number, or of that kind) contains the lectures and labs of its number, and all
    where one of the two has none; a lecture goes with the labs that are in a week of its own number; lectures introduce and labs prepare for a
    midterm: the item of its title (any case; of equal titles the last), else the first whose title speaks of a midterm, else itself.

    Numbers meet by course and number, and only entities without one meet a course's whole list, whose links they all are."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    course = F.coalesce(F.col("course_id").cast("string"), F.lit("x"))
    e = entities.select("course_id", "kind", "label", "week").distinct()
    weeks = e.filter("kind = 'week' OR week IS NOT NULL").select("course_id", "week", text("schedule:week:", course, ":", F.coalesce(F.col("week").cast("string"), F.col("label"))).alias("week_id")).distinct()
    of = lambda kind: e.filter(F.col("kind") == kind).select("course_id", F.col("week").alias("own"), text(f"schedule:{kind}:", course, ":", F.col("label")).alias("id")).distinct()
    lectures, labs = of("lecture"), of("lab")

    def met(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
        """Rows of one course with equal numbers, or of which one has none."""
        right = shuffled(right)
        keyed = left.join(right, left["course_id"].eqNullSafe(right["course_id"]) & (left[a] == right[b])).drop(right["course_id"])
        wild = left.filter(F.col(a).isNull()).join(right, left["course_id"].eqNullSafe(right["course_id"])).drop(right["course_id"])
        wild_too = left.filter(F.col(a).isNotNull()).join(right.filter(F.col(b).isNull()), left["course_id"].eqNullSafe(right["course_id"])).drop(right["course_id"])
        return keyed.unionByName(wild).unionByName(wild_too)

    link = lambda df, a, b, kind, sure: df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    contains = link(met(weeks, "week", lectures, "own"), "week_id", "id", "CONTAINS", 0.7).unionByName(link(met(weeks, "week", labs, "own"), "week_id", "id", "CONTAINS", 0.7))
    numbered = weeks.filter("week IS NOT NULL").select("course_id", "week").distinct()
    in_week = numbered.join(shuffled(lectures.withColumnRenamed("id", "lecture_id")), numbered["course_id"].eqNullSafe(lectures["course_id"]) & (F.col("week") == F.col("own"))).select(numbered["course_id"], "week", "lecture_id")
    beside = link(met(in_week, "week", labs, "own"), "lecture_id", "id", "ASSOCIATED_WITH", 0.55)
    titles = items.filter("title IS NOT NULL").select("course_id", F.lower("title").alias("low"), "ord", "item_id")
    by_title = titles.groupBy("course_id", "low").agg(F.max_by("item_id", "ord").alias("same"), F.min("ord").alias("ord"))
    speaks = by_title.filter(F.contains("low", F.lit("midterm"))).groupBy("course_id").agg(F.min_by("same", "ord").alias("spoken"))
    mids = e.filter("kind = 'midterm'").select("course_id", F.col("label").alias("title")).unionByName(midterms.select("course_id", "title")).filter("title IS NOT NULL").distinct()
    mids = mids.withColumn("low", F.lower("title")).join(shuffled(by_title.select("course_id", "low", "same")), ["course_id", "low"], "left").join(shuffled(speaks), "course_id", "left")
    mids = mids.select("course_id", F.coalesce(F.col("same").cast("string"), F.col("spoken").cast("string"), text("schedule:midterm:", course, ":", F.col("title"))).alias("mid_id")).distinct()
    with_mid = lambda rows: rows.join(shuffled(mids), rows["course_id"].eqNullSafe(mids["course_id"]))
    before = link(with_mid(lectures), "id", "mid_id", "INTRODUCED_DURING", 0.5).unionByName(link(with_mid(labs), "id", "mid_id", "PREPARES_FOR", 0.55))
    return contains.unionByName(beside).unionByName(before).distinct()
