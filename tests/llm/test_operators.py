"""Each operator against a brute-force form, with the cases that every one must take: nulls, empty and long texts, repeats, no rows, extra columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studyplane.llm import components, decontaminate, html_main, jaccard, langid, lm, packing, quality, queries, sharding, tokens, topk

EXTRA = ["score", "n", "x", "k1", "token", "chunk", "shard", "_text", "component", "Text2"]


def documents(spark, rows, **more):
    """rows of (doc_id, text) with columns whose names operators use inside."""
    kinds = {"lang": "string", "source": "string"} | dict.fromkeys(EXTRA, "string")
    full = [(i, t, *(more.get(k, lambda i: None)(i) for k in kinds)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, " + ", ".join(f"`{k}` {v}" for k, v in kinds.items()))


def sample(n=60, seed=1):
    """Texts with exact copies, near copies, a common passage, and the odd cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        if i % 5 == 1:
            words = texts[-1].split()
            if i % 10 == 1 and words:
                words[r.randrange(len(words))] = "Changed"
        if i % 7 == 3:
            words += passage.split()
        texts.append((" " if i % 2 else "\n").join(words).capitalize())
    rows = list(enumerate(texts))
    return [*rows, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE two"), (1005, "Über ñandú 東京 one"), (1006, " ".join(vocab * 40)), (None, "a text without an id"), (3, texts[3])]


@pytest.fixture(scope="module")
def rows():
    return sample()


def keyed(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_token_counts_are_the_librarys(spark, rows):
    from tokenizers import Tokenizer

    rows = [*rows, (2000, "a<|endoftext|>b  c\n\n d   e \n f don't 12 ¿qué? aaaaaaa"), (2001, "   ")]
    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = keyed(tokens.token_counts(documents(spark, rows), path, limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 50))
    assert got == sorted(want, key=repr)


def test_pair_merger_on_random_characters():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library, merger, r = Tokenizer.from_file(path), tokens.merger(path), random.Random(2)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), 32, 10, r.randrange(128, 0x2FFF)])) for _ in range(200)) for _ in range(100)]
    assert merger.text_counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing_keeps_every_token_once(spark, rows):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.packed(documents(spark, rows).coalesce(1), path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in rows:
        if i == 3:
            continue  # two rows have this id
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for p in pieces for x in p["ids"]] == ids
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        for p in pieces:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        size = sum(p["length"] for p in pieces)
        assert size <= 4096 and size & (size - 1) == 0 and {p["sequence_tokens"] for p in pieces} == {size}
    loads = Counter()
    for r in got:
        loads[r["step_id"]] += r["length"]
    assert len(loads) < 2 or max(loads.values()) - min(loads.values()) <= 4096


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097], [513, 513, 511, 3, 3000], list(range(1, 900, 7))])
def test_pack_covers_documents(lengths):
    made = packing.pack(lengths)
    seen = Counter()
    for s in made:
        size = sum(n for _, _, n in s)
        assert 0 < size <= 4096 and size & (size - 1) == 0
        for i, _, n in s:
            seen[i] += n
    assert [seen[i] for i in range(len(lengths))] == lengths


def test_sharding_moves_rows_only_into_the_new_shard(spark, rows):
    tree = sharding.regular_tree(2, 2, 4)
    many = [*rows, *((i, f"text {i % 7}") for i in range(5000, 9000))]
    got = sharding.sharded(documents(spark, many), tree).collect()
    assert len(got) == len(many)
    for s in range(16):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
        assert 170 < len(mine) < 340
    moved = [r for r in got if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {16} and 120 < len(moved) < 380
    text = {i: t for i, t in many if i != 3}
    for r in got:
        if r["doc_id"] in text:
            body = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")


def test_weight_changes_move_rows_inside_their_subtrees(spark):
    tree = sharding.regular_tree(2, 2, 2)
    heavier = [x if x.shard != 5 else sharding.Leaf(x.region, x.rack, x.shard, 2.0) for x in tree]
    r = spark.range(4000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).collect()
    moved = [(x["a"], x["b"]) for x in r if x["a"] != x["b"]]
    # into region 1 from region 0, into rack 2 from rack 3, into shard 5 from shard 4; never elsewhere
    assert moved and all(b >= 4 if a < 4 else b in (4, 5) if a >= 6 else (a, b) == (4, 5) for a, b in moved)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [])


def test_sharding_has_no_python(spark, rows):
    plan = sharding.sharded(documents(spark, rows), sharding.regular_tree(2, 2, 4))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = WORD.findall((t or "").encode().lower()), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes,pass_bytes", [(1 << 22, 1 << 28), (200, 1 << 28), (200, 600)])
def test_decontamination(spark, rows, monkeypatch, block_bytes, pass_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    items = [(1, rows[3][1]), (2, rows[10][1]), (3, "one two"), (4, None), (5, ""), (6, "!?"), (7, "Über"), (None, rows[17][1]), (2, "ñandú 東京")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminated(documents(spark, rows), bench)
    assert keyed(got, "doc_id", "n_words", "n_hit", "items") == brute_hits(rows, items)
    passes = got._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert passes == 1  # a pass ends before the next begins
    text = dict(rows)
    for r in got.filter("doc_id = 1003").collect():
        assert r["spans"] == [0, 7] and text[1003].encode()[0:7] == b"one two"
    assert got.count() == len(rows)
    assert decontaminate.decontaminated(documents(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_fm_index_on_repeats():
    s = np.array([2, 2, 3, 2, 2, 3, 2, 2, 3, 1, 3, 2, 1, 0])
    index = decontaminate.FMIndex(s, 4)
    assert decontaminate.suffix_array(s, 2).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    for n in (1, 2, 3, 5):
        for k in range(len(s) - n):
            p = s[k : k + n]
            low, high = index.search(p[None, :].astype(np.int64), np.array([n]))
            assert sorted(index.locate(np.arange(low[0], high[0]))) == [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]


def brute_groups(rows, n, least):
    sets, parent = [], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < n else set(zip(*(w[k:] for k in range(n)), strict=False)))
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= least * (len(sets[i]) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(ids[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("n,least", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, rows, n, least):
    got = jaccard.joined(documents(spark, rows), n, least)
    assert keyed(got, "doc_id", "n_shingles", "component_id") == brute_groups(rows, n, least)


def test_ngram_join_of_a_dense_group_and_a_chain(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    near = []
    for k in range(120):  # every copy has its own change; copies are less alike than copy and base
        words = list(base)
        words[r.randrange(80)] = f"own{k}"
        near.append((k + 100, " ".join(words)))
    chain = [(500 + k, " ".join(f"c{i}" for i in range(6 * k, 6 * k + 100))) for k in range(8)]
    rows = [(1, " ".join(base)), *near, *chain]
    got = jaccard.joined(documents(spark, rows), 4, 85)
    assert keyed(got, "doc_id", "n_shingles", "component_id") == brute_groups(rows, 4, 85)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (80, None), (90, 100), (100, 110), (90, 110)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert dict(keyed(got, "node", "component")) == dict.fromkeys(range(1, 41), 1) | {50: 50, 60: 50, 90: 90, 100: 90, 110: 90}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model(spark, rows):
    parts = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 5
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    held = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % 4 == 0
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.scored(documents(spark, rows), train, held).collect()}
    split = [(d, [*(t or "").encode().lower().split(), b"\0"]) for d, t in rows]
    counts = Counter(w for d, t in split if d is not None and parts(d) != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    for d, t in split:
        r = got[d, len(t)]
        assert (r["n_known"], r["train_tokens"]) == (sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert np.isfinite(r["score"]) and r["score"] <= 0


def test_language_model_uses_contexts(spark):
    """Words that depend on the one before: held-out texts are likelier than by single words."""
    r = random.Random(9)
    after = {w: r.sample(range(200), 3) for w in range(200)}
    rows = []
    for i in range(300):
        w, words = r.randrange(200), []
        for _ in range(60):
            words.append(f"w{w}")
            w = r.choice(after[w])
        rows.append((i, " ".join(words)))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = lm.scored(documents(spark, rows), fold % 5 != 1, F.floor(fold / 5) % 8 == 0).filter("NOT train")
    sums = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] / sums[2] > -0.75 > -2.0 > sums[1] / sums[2]


def test_language_model_is_a_distribution():
    """Weights sum to 1 in every bucket, also in those without held-out tokens."""
    cells = lm._cells(np.array([0, 3, 5]), np.array([0, 10, 900]), np.array([1, 4, 0]), 1000)
    w = lm.learned(cells, np.array([5, 2, 3]), 50)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0


def brute_top(rows, k):
    """Every row by itself: rows that share an id are candidates of each other's queries, and only a row's own vector is left out."""
    fine = []
    for i, e in rows:
        if e is not None and all(x is not None and np.isfinite(x) for x in e):
            fine.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in e]))
    out = []
    for n, (q, v) in enumerate(fine):
        if q is not None and q % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for m, (i, w) in enumerate(fine) if m != n and len(v) == len(w))
            out += [(q, r + 1, None if none else i, -x) for r, (x, none, i) in enumerate(s[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small,block", [(2048, 1 << 21), (16, 1 << 21), (16, 256)])
def test_top_k(spark, monkeypatch, small, block):
    monkeypatch.setattr(topk, "SMALL", small)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "FEW", 6)
    r = random.Random(3)
    vector = lambda: [r.gauss(0, 0.3) for _ in range(8)]
    same = vector()
    rows = [(i, same if i % 3 == 0 else vector()) for i in range(150)]
    rows += [(200, None), (205, []), (220, []), (206, [None] * 8), (207, [float("nan")] * 8), (208, [float("inf")] + [0.0] * 7), (None, vector()), (None, same), (10, same), (10, vector()), (210, [0.0] * 8), (215, [1e6] * 8)]
    rows += [(20, [1.0] + [0.0] * 7), (1, [1.0] + [0.0] * 7), (1, [40.0] + [0.0] * 7), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, 7)
    assert keyed(got, "query_id", "rank", "vec_id", "score") == brute_top(rows, 7)


def test_top_k_beyond_a_long(spark):
    """Scores that no long holds count as the largest or smallest long, and so tie."""
    rows = [(5, [1e12, 0.0]), (1, [2e12, 0.0]), (2, [3e12, 0.0]), (3, [1e30, 0.0]), (4, [-1e12, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 5, 4)
    most = 2**63 - 1
    assert keyed(got.orderBy("rank"), "rank", "vec_id", "score") == [(1, 1, most), (2, 2, most), (3, 3, most), (4, 4, -most - 1)]


def test_top_k_stops_on_proof():
    """Where few components are large, the last segments aren't read, and the result is the same."""
    r = np.random.default_rng(1)
    v = np.where(r.random((3000, 16)) < 0.2, r.integers(-4000, 4000, (3000, 16)), r.integers(-2, 3, (3000, 16)))
    block = topk.ImpactBlock(np.arange(3000), np.arange(3000), v)
    place, found, score = block.search(np.arange(40), v[:40], 10)
    assert block.skipped > block.read / 10
    full = v[:40] @ v.T
    for i in range(40):
        want = sorted((-full[i, c], c) for c in range(3000) if c != i)[:10]
        assert sorted(zip((-score[place == i]).tolist(), found[place == i].tolist(), strict=True)) == want


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class=ad-page><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy this thing now, it is good.</div><article><h1>The &amp; title</h1><p>First   paragraph<br>of <b>some</b> words.<p>Second &lt;one&gt;.
<script>var x = "<p>";</script><form><p>Your name</p></form></article><div class="comments"><p>I do not agree with any of this at all.</p></div><aside><p>Related things to read.</p></aside><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize("learned", [False, True])
def test_main_text(spark, learned):
    want = "The & title\n\nFirst paragraph of some words.\n\nSecond <one>."
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>Cut off in <b>the mid"), (5, "u", "<article><p>" + "Very long text. " * 20000), (6, "u", "<nav><a>x</a></nav>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = html_main.extracted(pages, html_main.fit(pages) if learned else None).collect()
    text = [(r["page_id"], r["text"], r["n_chars"]) for r in got]
    assert text.count((1, want, len(want))) == 2
    assert (2, "", 0) in text and (3, "", 0) in text and (6, "", 0) in text and (None, "Cut off in the mid", 18) in text
    assert len(got) == len(rows)


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=x><body><article>{}</article>",
        "<div class='content no-sidebar'>{}</div>",
        "<article class='post comments-open'>{}</article>",
        "<main class='text-share'>{}</main>",
        "<form action=x><div>{}</div><button>Send</button></form>",
        "<form><nav>Home</nav><article>{}</article></form>",
        "<svg width=1 /><article>{}</article>",
        "<noscript><article>{}</article>",
        "<body><header>Site name</header><ul class=main-nav><li>Home</ul><article>{}</article><section id=comments><article><p>I do not agree.</article></section>",
        "<table><tr><td>{}<td class=sidebar>See also this</table>",
        "<article>{}<aside><article><p>Another story of the site.</article></aside></article>",
        "<div class='cookie-notice'><p>We use cookies here, as all do, and we tell you.</p></div><main>{}</main>",
    ],
)
def test_main_text_of_awkward_markup(page):
    article = "<p>This is the first paragraph of the article, with enough words.<p>Short.</p>"
    assert html_main.main_text(page.format(article)) == "This is the first paragraph of the article, with enough words.\n\nShort."


def test_main_text_keeps_a_title_in_the_articles_header():
    page = "<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Text of the article, of some length.</p><footer>By me</footer></article>"
    assert html_main.main_text(page) == "Title\n\nText of the article, of some length."


def test_main_text_of_random_pages():
    """Pages made of known parts, with end tags left out at random, give the article's blocks and no other."""
    r = random.Random(11)
    words = lambda a, b: " ".join("".join(r.choice("abcdefghijk") for _ in range(r.randint(1, 8))) for _ in range(r.randint(a, b)))
    end = lambda tag: f"</{tag}>" if r.random() < 0.7 else ""
    for _ in range(150):
        paragraphs = [words(1, 60) + r.choice([".", "!", "", "?"]) for _ in range(r.randint(1, 8))]
        listed = [words(1, 6) for _ in range(r.randint(0, 4))]
        title = words(1, 8)
        article = f"<h1>{title}</h1>" + "".join(f"<p>{p}{end('p')}" for p in paragraphs) + ("<ul>" + "".join(f"<li><a href=x>{x}</a>{end('li')}" for x in listed) + "</ul>" if listed else "")
        article = r.choice(["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>"]).format(article)
        junk = lambda: "".join(
            r.choice(["<nav><ul>{}</ul></nav>", "<div class=ad>{}</div>", "<aside>{}</aside>", "<div class='sidebar-left box'>{}</div>", "<form><label>{}</label><input></form>", "<div id=comments>{}</div>", "<script>{}</script>", "<!-- {} -->", "<style>{}</style>", "<div role=navigation>{}</div>"]).format(
                f"<p>{words(1, 30)}."
            )
            for _ in range(r.randint(0, 3))
        )
        page = f"<!doctype html><title>{words(1, 4)}</title>" + junk() + article + junk() + f"<footer>&copy; {words(1, 9)}</footer>"
        assert html_main.main_text(page) == "\n\n".join([title, *paragraphs, *listed])


def test_the_cut_changes_labels():
    """Blocks that their own shape speaks against are content among content, and the other way round."""
    long = "<p>" + "This is a sentence of the article, which is long enough. " * 4 + "</p>"
    found = html_main.blocks(f"<div>{long}<div>Yes <a href=x>so</a></div>{long}</div>" + "<ul>" + "<li><a href=x>Home page</a></li>" * 4 + "</ul>")
    terminal, edges = html_main.graph(found)
    assert terminal[1] < 0 and html_main.labelled(found) == [True] * 3 + [False] * 4


def test_minimum_cut_is_minimal():
    from itertools import product

    r = random.Random(4)
    for _ in range(200):
        terminal = [r.uniform(-3, 3) for _ in range(7)]
        edges = [(a, b, r.random()) for a in range(7) for b in range(a) if r.random() < 0.4]
        cost = lambda s, t=terminal, e=edges: sum(max(x, 0) for x, k in zip(t, s, strict=True) if not k) + sum(max(-x, 0) for x, k in zip(t, s, strict=True) if k) + sum(c for a, b, c in e if s[a] != s[b])
        assert cost(html_main.minimum_cut(terminal, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=7))))


def test_language_id(spark):
    words = {"en": "the and of to in that it was for with", "de": "der die und das nicht ist ein von mit auch", "es": "el la que de los en una por con para"}
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(words[lang].split()) for _ in range(30)).capitalize()) for i in range(300) for lang in [["en", "de", "es"][i % 3]]]
    odd = [(1000, None), (1001, ""), (1002, "123 ... 456"), (1003, "漢字仮名交じり文"), (None, rows[0][1])]
    lang = lambda i: None if i is None or i >= 1000 or i % 11 == 0 else ["en", "de", "es"][i % 3]
    docs = documents(spark, rows + odd, lang=lang)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    got = langid.identified(docs, langid.fit(docs, train), keep=("text", "source")).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == ["en", "de", "es"][i % 3] and not by[i]["rejected"] for i, _ in rows)
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by[1003]["rejected"] and by[1003]["lang_pred"] != "und" and by[None]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}


def test_quality(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(r.randint(20, 80))).capitalize() + "."
    bad = lambda: " ".join(word().upper() + r.choice(["!!", "***", "$$$"]) for _ in range(r.randint(20, 80)))
    truth = {i: int(r.random() < 0.7) for i in range(600)}
    rows = [(i, good() if q else bad()) for i, q in truth.items()] + [(1000, None), (1001, ""), (None, good())]
    labels = spark.createDataFrame([(i, q, 0) for i, q in truth.items() if i % 2] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    got = {r["doc_id"]: r["score"] for r in quality.scored(documents(spark, rows), labels, train).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == truth[i] for i in held) / len(held) > 0.95
    none = quality.scored(documents(spark, rows), labels.limit(0), train).select(F.min("score"), F.max("score")).first()
    assert none[0] == pytest.approx(none[1]) == 0.5


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_quality_has_the_least_non_negative_risk(monkeypatch, prior):
    """No small change of the weights lowers the risk with its true max(0, .), whether the negative part is over 0 or at it."""
    r = np.random.default_rng(2)
    positive = np.arange(400) < 150
    x = r.normal(0, 1, (400, quality.FEATURES)).astype(np.float32)
    x[positive, :3] += 1.5
    x[np.arange(400) >= 220, :3] -= 1.0
    batch = pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), pa.array(positive)], ["x", "positive"])
    monkeypatch.setattr(quality, "_summed", lambda rows, width, of_batch: of_batch(batch))  # without Spark: some hundred passes
    rows = type("Rows", (), {"select": lambda self, *names: self})()
    model = quality.fit(quality.Table(rows), prior)
    z = model.inputs(x.astype(float))
    decay = np.full(quality.FEATURES + 1, quality.DECAY)
    decay[-1] /= 100

    def risk(w):
        g = z @ w
        negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[positive]).mean()
        return prior * np.logaddexp(0, -g[positive]).mean() + max(0.0, negative) + (decay * w * w).sum() / 2, negative

    least, negative = risk(model.weights)
    assert (abs(negative) < 2 * quality.NEAR) if prior > 0.5 else negative > quality.NEAR
    for _ in range(300):
        assert risk(model.weights + r.normal(0, r.choice([0.01, 0.1, 1.0]), len(decay)))[0] > least - 2 * quality.NEAR


def test_prior_without_negatives():
    r = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.85):
        score = lambda n, up: np.bincount(np.clip((r.beta(8 if up else 2, 2 if up else 8, n) * quality.BINS).astype(int), 0, quality.BINS - 1), minlength=quality.BINS)
        rows = score(int(40000 * prior), True) + score(int(40000 * (1 - prior)), False)
        assert abs(quality.prior_from(rows, score(8000, True)) - prior) < 0.05


def test_columns_to_keep_must_not_clash(spark, rows):
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for made in (lambda: quality.featured(docs, keep=("score",)), lambda: langid.identified(docs, None, keep=("source", "source")), lambda: decontaminate.decontaminated(docs, bench, keep=("doc_id",))):
        with pytest.raises(ValueError):
            made()
    assert langid.identified(docs, None, keep=("n", "Text2")).columns == ["doc_id", "n", "Text2", "lang_pred", "score", "rejected"]


def test_no_rows(spark):
    none = documents(spark, [])
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    yes = F.col("doc_id").isNotNull()
    made = [
        tokens.token_counts(none, queries.vocabulary("byte_bpe_50k.json")),
        packing.packed(none, queries.vocabulary("word_bpe_49k.json")),
        sharding.sharded(none, sharding.regular_tree(1, 1, 2)),
        decontaminate.decontaminated(none, bench),
        jaccard.joined(none),
        lm.scored(none, yes, yes),
        langid.identified(none, langid.fit(none, yes)),
        quality.scored(none, labels, yes),
        html_main.extracted(spark.createDataFrame([], "page_id long, url string, html string")),
        topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0),
    ]
    assert [df.count() for df in made] == [0] * 10
