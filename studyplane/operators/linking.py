"""Links by titles that hold one another: gradebooks, facts, content and posts to items; related texts; tools outside the system; staff of a course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded
from .graph import settled

#: Characters of the pieces by which texts that hold one another are found.
GRAM = 3

#: Texts of a scope up to which all of them meet, if that makes no more pairs than PAIRS.
FEW, PAIRS = 256, 1 << 20

#: Kinds of items whose number follows them (fixed values).
NUMBERED = bounded(r"\b(assignment|lab|quiz|project|homework|a)\s*#?\s*(\d+)\b")

#: Mentions of an online textbook's activities, ranges of them, and its group (fixed values). Numbers over TOP_ACTIVITY are none.
ACTIVITY = bounded(r"\b(?:zybooks?\s*)?(?:activity\s*)?q\s*([1-9]\d?)\b")
ACTIVITY_RANGE = bounded(r"\bq\s*([1-9]\d?)\s*(?:through|thru|to|-|–|—)\s*q?\s*([1-9]\d?)\b")
BEST_FIVE = r"best\s*5\s*(?:of|/)\s*6"
TOP_ACTIVITY = 20
TOOLS = r"zybooks\.com|pearson|wiley|connect\.|crowdmark|gradescope"


def _pieces(text: Column, size: int) -> Column:
    """The distinct substrings of that many characters."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def shuffled(rows: DataFrame) -> DataFrame:
    """The rows for a join that sorts both sides. Spark takes exploded and packed rows for as small as the file they come from, and would
    gather them in the driver to broadcast them."""
    return rows.hint("merge")


def contained(needles: DataFrame, hays: DataFrame, scope: str = "course_id") -> DataFrame:
    """scope, needle and hay of every pair of distinct texts of one scope in which the hay holds the needle; empty and null texts have none.

    needles: scope, needle; hays: scope, hay. A scope with FEW of either, and PAIRS at most, compares them all. In others a needle looks only
    at the hays with that of its pieces (GRAM characters, or all of a shorter needle) which the fewest hays of the scope have, so that frequent
    pieces never make pairs."""
    wanted = needles.filter(f"needle <> '' AND {scope} IS NOT NULL").select(scope, "needle").distinct()
    texts = hays.filter(f"hay <> '' AND {scope} IS NOT NULL").select(scope, "hay").distinct()
    count = lambda rows, name: rows.groupBy(scope).agg(F.count("*").alias(name))
    sizes = count(wanted, "n").join(shuffled(count(texts, "m")), scope)
    small = (F.least("n", "m") <= FEW) & (F.col("n") * F.col("m") <= PAIRS)
    of = lambda rows, which: rows.join(shuffled(sizes.filter(which).select(scope)), scope, "left_semi")
    holds = F.contains("hay", "needle")
    direct = of(wanted, small).join(shuffled(texts), scope).filter(holds).select(scope, "needle", "hay")
    wanted, texts = of(wanted, ~small), of(texts, ~small)
    short = _pieces(F.col("hay"), 1)
    for size in range(2, GRAM + 1):
        short = F.concat(short, _pieces(F.col("hay"), size))
    held = texts.select(scope, "hay", F.explode(short).alias("piece"))
    often = held.groupBy(scope, "piece").agg(F.count("*").alias("often"))
    own = wanted.select(scope, "needle", F.explode(F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(_pieces(F.col("needle"), GRAM))).alias("piece"))
    rare = own.join(shuffled(often), [scope, "piece"], "left").groupBy(scope, "needle").agg(F.min_by("piece", F.struct(F.coalesce("often", F.lit(0)), "piece")).alias("piece"))
    return direct.unionByName(rare.join(shuffled(held), [scope, "piece"]).filter(holds).select(scope, "needle", "hay"))


def by_title(rows: DataFrame, items: DataFrame, empty: bool = True, exact_first: bool = True, scope: str = "course_id") -> DataFrame:
    """scope, key, item_id, score and first_id for each distinct key of rows that names an item: equal keys count 100, one within the other 70;
    the first item (ord, then item_id) of the best score, or of any where exact_first is off; first_id is the first of any.

    rows: scope, key; items: scope, key, ord, item_id. An empty key of an item is within every key, and one of a row is within every item's,
    unless `empty` is off: then it names none. Null keys and scopes name none."""
    mine = rows.filter(f"key IS NOT NULL AND {scope} IS NOT NULL").select(scope, "key").distinct()
    if not empty:
        mine = mine.filter("key <> ''")
    mine = settled(mine)  # both are looked at in many ways
    firsts = settled(items.filter(f"key IS NOT NULL AND {scope} IS NOT NULL").groupBy(scope, F.col("key").alias("item_key")).agg(F.min(F.struct("ord", "item_id")).alias("first")))
    theirs = firsts.select(scope, F.col("item_key").alias("hay"))
    inside = contained(mine.withColumnRenamed("key", "needle"), theirs, scope).select(scope, F.col("needle").alias("key"), F.col("hay").alias("item_key"))
    around = contained(theirs.withColumnRenamed("hay", "needle"), mine.withColumnRenamed("key", "hay"), scope).select(scope, F.col("hay").alias("key"), F.col("needle").alias("item_key"))
    part = inside.union(around).join(shuffled(firsts), [scope, "item_key"])
    blank = mine.join(shuffled(firsts.filter("item_key = ''")), scope).select(scope, "item_key", "key", "first")
    whole = mine.filter("key = ''").join(shuffled(firsts.groupBy(scope).agg(F.min_by("item_key", "first").alias("item_key"), F.min("first").alias("first"))), scope).select(scope, "item_key", "key", "first")
    met = part.select(scope, "item_key", "key", "first").union(blank).union(whole)
    score = F.when(F.col("key") == F.col("item_key"), 100).otherwise(70)
    ranked = met.select(scope, "key", score.alias("score"), "first", (-score if exact_first else F.lit(0)).alias("tier"))
    best = ranked.groupBy(scope, "key").agg(F.min_by(F.struct("first.item_id", "score"), F.struct("tier", "first")).alias("b"), F.min("first")["item_id"].alias("first_id"))
    return best.select(scope, "key", "b.item_id", "b.score", "first_id")


def gradebook_map(grades: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """grade_id, item_id, category_id and unmatched of every grade: the item of its tool id, else the one that its title names best; the first
    category of whose title key the first eight characters are within the grade's.

    grades: grade_id, course_id, tool_id, key. items: course_id, tool_id, key, ord, item_id. categories: course_id, key, ord, category_id. An
    empty category key is within every title. Null courses match nothing. What the grades of a course distinctly say is looked up once."""
    by = ["course_id", "tool_id", "key"]
    said = settled(grades.select(*by).distinct())
    tool = items.filter("tool_id IS NOT NULL").groupBy("course_id", "tool_id").agg(F.min_by("item_id", F.struct("ord", "item_id")).alias("of_tool"))
    named = by_title(said, items).select("course_id", "key", F.col("item_id").alias("of_title"))
    heads = categories.select("course_id", F.left("key", F.lit(8)).alias("needle"), F.struct("ord", "category_id").alias("first"))
    held = contained(heads, said.select("course_id", F.col("key").alias("hay"))).join(shuffled(heads), ["course_id", "needle"]).select("course_id", F.col("hay").alias("key"), "first")
    everywhere = heads.filter("needle = ''").groupBy("course_id").agg(F.min("first").alias("any"))
    category = held.groupBy("course_id", "key").agg(F.min("first").alias("first"))
    met = said.join(shuffled(tool), ["course_id", "tool_id"], "left").join(shuffled(named), ["course_id", "key"], "left").join(shuffled(category), ["course_id", "key"], "left").join(shuffled(everywhere), "course_id", "left")
    found = met.select(*(F.col(c).alias(f"_{c}") for c in by), F.coalesce("of_tool", "of_title").alias("item_id"), F.least("first", F.when(F.col("key").isNotNull(), F.col("any")))["category_id"].alias("category_id"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return grades.join(shuffled(found), same, "left").select("grade_id", "item_id", "category_id", F.col("item_id").isNull().alias("unmatched"))


def content_items(topics: DataFrame, items: DataFrame) -> DataFrame:
    """topic_id and item_id of content that names an item: the first item whose title is within the topic's, or holds its first 24 characters;
    else the first with the same kind and number.

    topics: topic_id, course_id, title; items: course_id, title, ord, item_id. Case counts for nothing. An item without a title is within
    every title and a topic without one within every item, so both meet the first such."""
    t = topics.select("topic_id", "course_id", F.lower("title").alias("low")).withColumn("head", F.left("low", F.lit(24)))
    firsts = items.groupBy("course_id", F.lower("title").alias("item_low")).agg(F.min(F.struct("ord", "item_id")).alias("first")).filter("item_low IS NOT NULL")
    theirs = firsts.select("course_id", F.col("item_low").alias("needle"))
    inside = contained(theirs, t.select("course_id", F.col("low").alias("hay"))).withColumnRenamed("needle", "item_low").join(shuffled(firsts), ["course_id", "item_low"]).select("course_id", F.col("hay").alias("low"), "first")
    holds = contained(t.select("course_id", F.col("head").alias("needle")), theirs.withColumnRenamed("needle", "hay")).withColumnRenamed("hay", "item_low").join(shuffled(firsts), ["course_id", "item_low"]).select("course_id", F.col("needle").alias("head"), "first")
    best = lambda rows, key, name: rows.groupBy("course_id", key).agg(F.min("first").alias(name))
    blank = firsts.filter("item_low = ''").select("course_id", F.col("first").alias("blank"))
    least = firsts.groupBy("course_id").agg(F.min("first").alias("least"))
    kinds = items.select("course_id", F.struct("ord", "item_id").alias("first"), F.lower("title").alias("low"))
    g = lambda k: F.regexp_extract_all("low", F.lit(NUMBERED), F.lit(k))
    numbered = kinds.select("course_id", "first", F.inline(F.arrays_zip(g(1).alias("kind"), g(2).alias("number")))).groupBy("course_id", "kind", "number").agg(F.min("first").alias("same"))
    one = lambda k: F.regexp_extract("low", NUMBERED, k)
    met = t.withColumns({"kind": one(1), "number": one(2)}).join(shuffled(best(inside, "low", "a")), ["course_id", "low"], "left").join(shuffled(best(holds, "head", "b")), ["course_id", "head"], "left")
    met = met.join(shuffled(blank), "course_id", "left").join(shuffled(least), "course_id", "left").join(shuffled(numbered), ["course_id", "kind", "number"], "left")
    known = F.col("low").isNotNull()
    item = F.coalesce(F.least("a", "b", F.when(known, F.col("blank")), F.when(F.col("low") == "", F.col("least"))), "same")["item_id"]
    return met.select("topic_id", item.alias("item_id")).filter("item_id IS NOT NULL")


def about(posts: DataFrame, items: DataFrame) -> DataFrame:
    """post_id and item_id: the first item of the course the first twelve characters of whose title key are in the post's key.

    posts: post_id, course_id, key (of the subject and the first 80 characters); items: course_id, key, ord, item_id. Items without a key name
    no post."""
    heads = items.filter("key <> ''").groupBy("course_id", F.left("key", F.lit(12)).alias("needle")).agg(F.min(F.struct("ord", "item_id")).alias("first"))
    held = contained(heads, posts.select("course_id", F.col("key").alias("hay"))).join(shuffled(heads), ["course_id", "needle"])
    best = held.groupBy("course_id", F.col("hay").alias("key")).agg(F.min("first")["item_id"].alias("item_id"))
    return posts.join(shuffled(best), ["course_id", "key"]).select("post_id", "item_id")


def related(items: DataFrame, texts: DataFrame, head: int) -> DataFrame:
    """item_id and n_related of every item: texts of its course that are always related, or that hold the first `head` characters of its title.

    items: item_id, course_id, title; texts: course_id, text, always. Case counts for nothing; an item without a title is in every text."""
    low = F.lower("text")
    counted = texts.filter("NOT always AND text IS NOT NULL").groupBy("course_id", low.alias("hay")).agg(F.count("*").alias("n"))
    heads = items.select("item_id", "course_id", F.left(F.lower("title"), F.lit(head)).alias("needle"))
    held = contained(heads, counted).join(shuffled(counted), ["course_id", "hay"]).groupBy("course_id", "needle").agg(F.sum("n").alias("named"))
    whole = texts.groupBy("course_id").agg(F.count_if("always").alias("n_always"), F.count_if(F.expr("NOT always AND text IS NOT NULL")).alias("n_other"))
    met = heads.join(shuffled(held), ["course_id", "needle"], "left").join(shuffled(whole), "course_id", "left")
    named = F.when(F.col("needle") == "", F.col("n_other")).otherwise(F.col("named"))
    return met.select("item_id", (F.coalesce("n_always", F.lit(0)) + F.coalesce(named, F.lit(0))).alias("n_related"))


def staff_names(courses: DataFrame, people: DataFrame) -> DataFrame:
    """course_id, instructors, tas and everyone of each course: names and aliases by role, sorted and once each.

    courses: course_id, instructor_names (array); people: course_id, role, name, aliases (array)."""
    said = people.select("course_id", "role", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    stated = courses.select("course_id", F.lit("instructor").alias("role"), F.explode("instructor_names").alias("name"))
    of = lambda *roles: F.array_sort(F.collect_set(F.when(F.col("role").isin(*roles), F.col("name"))))
    found = said.unionByName(stated).groupBy("course_id").agg(of("instructor").alias("instructors"), of("ta").alias("tas"), of("instructor", "ta", "staff").alias("everyone"))
    none = F.array().cast("array<string>")
    return courses.select("course_id").join(found, "course_id", "left").select("course_id", *(F.coalesce(c, none).alias(c) for c in ("instructors", "tas", "everyone")))


def activities(titles: DataFrame) -> DataFrame:
    """course_id, number, best_n, group_size and synthetic: activities of an online textbook that titles of a course mention, and whether an
    item has to be made for one since no item names it.

    titles: course_id, ord, title, is_item. Of ranges ("Q1 to Q6") a course's first counts; "best 5 of 6" alone means one to six. A course has
    such activities if it mentions three numbers, or the textbook and one. Numbers of a title count as such, whole titles are read."""
    low = F.lower(F.coalesce("title", F.lit("")))
    said = F.filter(F.transform(F.regexp_extract_all(low, F.lit(ACTIVITY), F.lit(1)), lambda x: x.cast("int")), lambda n: n <= TOP_ACTIVITY)
    bits = F.aggregate(said, F.lit(0), lambda all_, n: all_.bitwiseOR(F.call_function("shiftleft", F.lit(1), n)))  # a course's numbers are 20 bits
    of = lambda mask: F.filter(F.sequence(F.lit(1), F.lit(TOP_ACTIVITY)), lambda n: F.call_function("shiftright", F.col(mask), n).bitwiseAND(F.lit(1)) == 1)
    ends = F.array(*(F.regexp_extract(low, ACTIVITY_RANGE, k).try_cast("int") for k in (1, 2)))
    t = titles.select("course_id", "ord", "is_item", bits.alias("bits"), F.when(low.rlike(ACTIVITY_RANGE), ends).alias("ends"), low.contains("zybook").alias("book"), low.rlike(BEST_FIVE).alias("five"))
    course = t.groupBy("course_id").agg(
        F.bit_or("bits").alias("said"),
        F.min_by("ends", F.when(F.col("ends").isNotNull(), F.col("ord"))).alias("ends"),
        F.max("book").alias("book"),
        F.max("five").alias("five"),
        F.coalesce(F.bit_or(F.when(F.col("is_item") & F.col("book"), F.col("bits"))), F.lit(0)).alias("items"),
    )
    between = F.filter(F.sequence(F.array_min("ends"), F.array_max("ends")), lambda n: n <= TOP_ACTIVITY)
    known = F.array_sort(F.array_distinct(F.concat(of("said"), F.coalesce(between, F.array().cast("array<int>")))))
    course = course.withColumn("numbers", F.when((F.size(known) == 0) & F.col("book") & F.col("five"), F.sequence(F.lit(1), F.lit(6))).otherwise(known)).withColumn("n", F.size("numbers"))
    kept = course.filter((F.col("n") >= 3) | (F.col("book") & (F.col("n") >= 1)))
    best = F.when(F.col("n") >= 6, 5).otherwise(F.greatest(F.col("n") - 1, F.lit(1)))
    out = kept.select("course_id", F.explode("numbers").alias("number"), best.alias("best_n"), F.greatest("n", F.lit(6)).alias("group_size"), of("items").alias("items"))
    return out.withColumn("synthetic", ~F.array_contains("items", F.col("number"))).drop("items")


def tool_of(url: Column) -> Column:
    """The outside tool that an address belongs to, or null (fixed values)."""
    low = F.lower(url)
    return F.when(low.rlike(TOOLS), F.when(low.contains("zybook"), "zybooks").when(low.contains("gradescope"), "gradescope").when(low.contains("crowdmark"), "crowdmark").otherwise("external"))
