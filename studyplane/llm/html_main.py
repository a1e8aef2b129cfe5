"""Main text of web pages by minimum-cut labelling of their blocks.

A page's blocks and its telling elements (article, nav, class "comments" and such) are the nodes. A classifier of the shape of a block,
trained on blocks whose place in pages is beyond doubt, gives the blocks' terminal capacities; telling elements are bound to their own
terminal; neighbours on the page, neighbours below one parent, and blocks and the nearest telling element around them are joined by edges."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, small_batches

#: Elements that begin and end a block; those without content; those whose content is no markup and no text of the page; those whose
#: content belongs to controls; those beyond which an end tag or a new paragraph doesn't reach.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
CONTROL = frozenset("button select datalist".split())
SCOPE = frozenset("html table td th caption button object".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
CELLS = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}

#: Telling elements and roles.
AGAINST = frozenset("nav footer aside dialog menu fieldset".split())
AGAINST_OUTSIDE = frozenset({"header"})
AGAINST_UNLESS_WHOLE = frozenset({"form"})
FOR = frozenset("article main".split())
ROLES_AGAINST = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
ROLES_FOR = frozenset("main article".split())

#: Those of them, and of the words below, that say where something stands rather than what it is: around over half of the text they tell nothing.
WEAK, ROLES_WEAK = frozenset("dialog menu fieldset".split()), frozenset("dialog alertdialog menu menubar form".split())
WORDS_WEAK = frozenset("banner menu menus modal notice notices popup promo widget".split())

#: Telling classes and ids. A name of several parts tells only where all parts are known, and not where one of them makes it a state.
WORDS_AGAINST = frozenset(
    "ad ads adsbygoogle advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices pagination popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
WORDS_FOR = frozenset("article content entry main post story".split())
WORDS_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons consent container content global group header inner item items left link links list main outer overlay page panel post reader readers right row section site slot thread top unit wrap wrapper".split()
)
WORDS_STATE = frozenset("no not without has with is open opened closed on off enabled disabled allowed active".split())

#: Capacities: of neighbours on the page (falling with their distance in the DOM), of neighbours below one parent, of a block to the
#: telling element around it (less if only a class or id speaks for content), and of that element to its terminal. The classifier's
#: log-odds are held within SURE, so that a block that it is sure of can overrule the element around it with its neighbours, and a class alone.
ADJACENT, SIBLINGS, AROUND, NAMED, TELLING, SURE = 1.5, 0.75, 5.0, 3.0, 1000.0, 4.0

#: Bound of the fit: pages drawn by a hash, and blocks of each. Weight of the prior weights (a share of the blocks seen and 1000 more, so
#: that neither a few blocks nor one site's habits take over), and rounds of Newton's method.
FIT_PAGES, FIT_BLOCKS, PRIOR_SHARE, ROUNDS = 4000, 64, 0.05, 12

#: What a block's shape is to say before any page is seen, feature by feature as in `shape`.
PRIOR_WEIGHTS = np.array([-1.0, 2.5, -4.0, 1.0, 1.0, 1.5, 0.5, -0.5, 1.0, -1.0, 0.5, 0.0])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(eq=False)
class Element:
    """An element with what it tells (-1, 0 or 1), how firmly, whether it would tell nothing where it holds the whole page (unless_whole: or an
    article; weak: most of the text around it), the characters in it, and the nearest elements, itself included, that tell against and for
    content."""

    name: str
    depth: int
    parent: Element | None
    linked: bool = False
    muted: bool = False
    tells: int = 0
    hold: float = AROUND
    unless_whole: bool = False
    weak: bool = False
    text: int = 0
    against: Element | None = None
    favour: Element | None = None


@dataclass
class Block:
    """A run of text between block borders: its text, the characters of it in links, and the element that holds it."""

    text: str
    linked: int
    holder: Element
    shape: list[float] = field(default_factory=list)


def name_tells(name: str) -> int:
    """What one class or id tells: -1, 0 or 1."""
    parts = [p.lower() for p in _PART.findall(name)]
    if any(p in WORDS_STATE for p in parts):
        return 0
    if any(p in WORDS_AGAINST for p in parts):
        return -1 if all(p in WORDS_AGAINST or p in WORDS_NEUTRAL for p in parts) else 0
    return 1 if len(parts) == 1 and parts[0] in WORDS_FOR else 0


def _is_weak(name: str) -> bool:
    """Whether a class or id that tells against says no more than where something stands."""
    return all(p not in WORDS_AGAINST or p in WORDS_WEAK for p in (p.lower() for p in _PART.findall(name)))


def _entered(name: str, attributes: str, parent: Element) -> Element:
    out = Element(name, parent.depth + 1, parent, parent.linked or name == "a", parent.muted or name in CONTROL)
    inside, named = parent.favour is not None and parent.against is None, False
    if name in FOR:
        out.tells = 1
    elif name in AGAINST or (name in AGAINST_OUTSIDE and not inside):
        out.tells, out.weak = -1, name in WEAK
    elif name in AGAINST_UNLESS_WHOLE:
        out.tells, out.unless_whole = -1, True
    if attributes and "=" in attributes:
        for kind, *values in _ATTRIBUTE.findall(attributes):
            words = html.unescape(next(filter(None, values), "")).split()
            if kind.lower() == "role":
                roles = {w.lower() for w in words}
                if roles & ROLES_FOR:
                    out.tells = 1
                elif roles & ROLES_AGAINST:
                    out.tells, out.weak = -1, not roles & ROLES_AGAINST - ROLES_WEAK and (out.weak or out.tells >= 0)
            elif name not in ("html", "body", "main"):
                told = {name_tells(w) for w in words}
                if -1 in told:
                    out.tells, out.weak = -1, all(_is_weak(w) for w in words if name_tells(w) < 0) and (out.weak or out.unless_whole or out.tells >= 0)
                elif 1 in told and not out.tells:
                    out.tells, named = 1, True
    if out.tells > 0 and named:
        out.hold = NAMED
    out.against = out if out.tells < 0 else parent.against
    out.favour = out if out.tells > 0 else parent.favour
    return out


def _around(e: Element) -> Element | None:
    """The telling element around: the nearest that tells against, if there is any, else the nearest one."""
    against = e.against
    while against is not None and not against.tells:  # it tells nothing any more
        against = against.parent.against
    return against or e.favour


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. Comments, scripts, styles, drawings, controls and unfinished tags leave nothing.

    End tags may lack, as HTML lets them: of html, head, body, p, li, dt, dd, tr, td, th. A raw element that never ends is skipped as a
    tag only, but for scripts and styles; a drawing may close itself."""
    root = Element("", 0, None)
    here, out, low = root, [], page.lower()
    held: list[tuple[str, bool]] = []
    weak: list[Element] = []
    open_names: dict[str, int] = {}
    endless: set[str] = set()

    def flush() -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            holder = here
            while holder.name and holder.name not in BLOCK:
                holder = holder.parent
            out.append(Block(text, sum(len(" ".join(t.split())) for t, linked in held if linked), holder))
            e = holder
            while e is not None:
                e.text += len(text)
                e = e.parent
        held.clear()

    def leave(name: str) -> None:
        nonlocal here
        while here.name != name:
            open_names[here.name] -= 1
            here = here.parent
        open_names[name] -= 1
        here = here.parent

    def reaches(name: str, borders) -> bool:
        """Whether an open element of that name is found before a border."""
        e = here
        while e.name != name:
            if e is root or e.name in borders:
                return False
            e = e.parent
        return True

    at = 0
    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not here.muted:
            held.append((html.unescape(page[at:end]), here.linked))
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in BLOCK:
                flush()
            if open_names.get(name) and (name in SCOPE or reaches(name, SCOPE)):
                leave(name)
            continue
        if name in RAW:
            if name == "svg" and m["attributes"].endswith("/"):
                continue
            close = -1 if name in endless else low.find(f"</{name}", at)
            if close >= 0:
                stop = page.find(">", close)
                at = len(page) if stop < 0 else stop + 1
            else:
                endless.add(name)
                if name in ("script", "style"):
                    at = len(page)
            continue
        if name in BLOCK:
            flush()
            for same in (name, CELLS.get(name)):
                if name in CLOSED_BY_SAME and same and open_names.get(same) and reaches(same, CLOSED_BY_SAME[name]):
                    leave(same)
                    break
            if open_names.get("p") and reaches("p", SCOPE):
                leave("p")
        elif name == "br":
            held.append((" ", here.linked))
        elif name == "a" and open_names.get("a") and reaches("a", SCOPE):
            leave("a")
        if name not in VOID:
            here = _entered(name, m["attributes"], here)
            if here.weak:
                weak.append(here)
            open_names[name] = open_names.get(name, 0) + 1
    flush()
    articles = {id(b.holder.favour): b.holder.favour for b in out if b.holder.favour is not None}
    if articles:  # a form around an article tells nothing
        above = [e.parent for e in articles.values()]
    else:  # nor does one around most of a page that has no article
        above = [b.holder for b in out]
    for e in above:
        while e is not None:
            if e.unless_whole and (articles or 2 * e.text > root.text):
                e.tells = 0
            e = e.parent
    for e in weak:
        if 2 * e.text > (e.parent.favour or root).text:
            e.tells = 0
    _shape(out)
    return out


def _shape(found: list[Block]) -> None:
    """Each block's features: one, words (log), link share, a sentence's end, commas, heading, paragraph, list item, the
    neighbours' words (log) and link share, length against the longest block, place on the page. No class, role or telling element."""
    if not found:
        return
    words = [log1p(b.text.count(" ") + 1) / 5 for b in found]
    linked = [min(1.0, b.linked / len(b.text)) for b in found]
    longest = max(len(b.text) for b in found)
    last = len(found) - 1
    for i, b in enumerate(found):
        near = [k for k in (i - 1, i + 1) if 0 <= k <= last]
        name = b.holder.name
        b.shape = [
            1.0,
            words[i],
            linked[i],
            float(b.text[-1] in ".!?…。"),
            min(1.0, 10 * b.text.count(",") / len(b.text)),
            float(name in ("h1", "h2", "h3")),
            float(name in ("p", "pre", "blockquote")),
            float(name in ("li", "td", "th", "option")),
            sum(words[k] for k in near) / max(1, len(near)),
            sum(linked[k] for k in near) / max(1, len(near)),
            len(b.text) / longest,
            i / max(1, last),
        ]


def distance(a: Element, b: Element) -> int:
    """Steps in the DOM between two elements."""
    steps = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a = a.parent
        steps += 1
    return steps


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: those of a minimum cut where node i has the capacity terminal[i] from the source, or -terminal[i]
    to the sink, and edges join nodes in both directions.

    A node whose terminal outweighs all its edges is on that terminal's side in a minimum cut, so it is settled first and its edges go
    over to the terminals of its neighbours; what is left is cut by a maximum flow."""
    n = len(terminal)
    terminal = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if side[i] is not None or abs(terminal[i]) < sum(near[i].values()):
            continue
        side[i] = terminal[i] >= 0
        for j, c in near[i].items():
            terminal[j] += c if side[i] else -c
            del near[j][i]
            queue.append(j)
        near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        rest = [(place[i], place[j], c) for i in left for j, c in near[i].items() if i < j]
        for i, s in zip(left, _flow_cut([terminal[i] for i in left], rest), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def _flow_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side after a maximum flow: shortest augmenting paths, a blocking flow at a time."""
    n = len(terminal)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, forth: float, back: float) -> None:
        near[a].append(len(to))
        to.append(b)
        room.append(forth)
        near[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(terminal):
        if c > 0:
            connect(source, i, c, 0.0)
        elif c < 0:
            connect(i, sink, -c, 0.0)
    for a, b, c in edges:
        connect(a, b, c, c)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for v in queue:
            for e in near[v]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= least)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[v] < len(near[v]) and not (room[near[v][turn[v]]] > least and level[to[near[v][turn[v]]]] == level[v] + 1):
                turn[v] += 1
            if turn[v] < len(near[v]):
                path.append(near[v][turn[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                turn[v] += 1
            else:
                break


def graph(found: list[Block], weights: np.ndarray = PRIOR_WEIGHTS) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities and edges: the blocks first, then the telling elements around them.

    A page where nothing tells for content is still taken to have some: its longest block that nothing tells against, unless it is links."""
    terminal = np.clip(np.array([b.shape for b in found]).reshape(-1, len(weights)) @ weights, -SURE, SURE).tolist()
    if all(b.holder.favour is None for b in found):
        free = [i for i, b in enumerate(found) if _around(b.holder) is None and 2 * b.linked < len(b.text)]
        if free:
            terminal[max(free, key=lambda i: (len(found[i].text), -i))] = SURE
    edges, last_below, telling = [], {}, {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT * exp(2 - max(2, distance(found[i - 1].holder, b.holder)))))
        below = id(b.holder.parent)
        if below in last_below and last_below[below] != i - 1:
            edges.append((last_below[below], i, SIBLINGS))
        last_below[below] = i
        around = _around(b.holder)
        if around is not None:
            if id(around) not in telling:
                telling[id(around)] = len(terminal)
                terminal.append(TELLING * around.tells)
            edges.append((i, telling[id(around)], around.hold))
    return terminal, edges


def labelled(found: list[Block], weights: np.ndarray = PRIOR_WEIGHTS) -> list[bool]:
    """Whether each block is content."""
    if not found:
        return []
    terminal, edges = graph(found, weights)
    return minimum_cut(terminal, edges)[: len(found)]


def main_text(page: str | None, weights: np.ndarray = PRIOR_WEIGHTS) -> str:
    """The content blocks of a page, with an empty line between two."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, content in zip(found, labelled(found, weights), strict=True) if content)


def learned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of shapes x and labels y (0 or 1), both labels counting alike, near PRIOR_WEIGHTS where x says little."""
    w = PRIOR_WEIGHTS.copy()
    n, positive = len(y), float(y.sum())
    if not 0 < positive < n:
        return w
    pull = PRIOR_SHARE * (n + 1000)
    share = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + pull * (w - PRIOR_WEIGHTS)
        curvature = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pull * np.eye(len(w))
        move = np.linalg.solve(curvature, gradient)
        w = w - move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    """Weights of the block classifier, learned from blocks whose place in their page is beyond doubt: inside a telling element.

    A bounded sample: about FIT_PAGES pages drawn by a hash of their html, and at most FIT_BLOCKS blocks of each, evenly spread. Without
    such blocks the prior weights stay."""
    small_batches(pages.sparkSession)
    body = pages.select(F.col(html_col).alias("html")).filter(F.length("html") > 0)
    n = body.count()
    drawn = body.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < min(1.0, FIT_PAGES / max(1, n)) * (1 << 30))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page in b.column(0).to_pylist():
                sure = [(x, e.tells) for x in blocks(page) if (e := _around(x.holder)) is not None and e.hold != NAMED]
                rows += [np.array([*x.shape, t > 0], np.float32).tobytes() for x, t in sure[:: -(-len(sure) // FIT_BLOCKS) or 1]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["x"])

    got = sorted(bytes(r["x"]) for r in drawn.mapInArrow(over_batches(shapes), "x binary").collect())
    x = np.frombuffer(b"".join(got), np.float32).reshape(-1, len(PRIOR_WEIGHTS) + 1).astype(float)
    return learned(x[:, :-1], x[:, -1])


def extracted(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. weights: those of `fit`, else the prior ones.

    Null html counts as empty, which has an empty text; broken and cut-off markup is read as far as it goes; null ids and urls and
    repeated rows are kept; other columns are not read; no rows give no rows. Pages are read whole; work grows with a page's blocks."""
    small_batches(pages.sparkSession)
    body = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(body.dtypes)
    w = PRIOR_WEIGHTS if weights is None else weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, w) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return body.mapInArrow(over_batches(rows), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
