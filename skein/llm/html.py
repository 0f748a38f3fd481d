"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: stretches of text between block-level tags, with the path of open
elements (tags and words of class, id and role) and the share of linked text. Each block becomes a vector:
the path's tokens and the text's words, hashed, beside lengths and shares. A bidirectional LSTM (numpy) reads
the whole page's vectors in both directions and says of every block whether it is main text.

Pages carry no labels, so the labeller learns from those whose markup says it: in a bounded sample, blocks
whose nearest telling ancestor is an article or main part are main text; what stands in menus, headers,
footers, sidebars, notices, adverts, forms and comments, or outside the article, is not. Each sampled page is
learned as it is and in other layouts: telling elements are renamed or lose their names, and menus, sidebars,
notices, forms and comments, filled with texts of other sampled pages, are put before and after the article.
So the labeller has to use context where names say nothing. Which block a scored page has as main text is the
network's verdict alone.

Results: a null html is empty; a page without blocks, or without one that is main text, has an empty text.
Broken markup is read as far as it goes: unclosed elements end with their parents, unknown tags are inline.
Repeated rows are each extracted. Without a sampled page that has an article nothing is main text. No rows
give no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import column, parts, written
from skein.llm.recurrent import AT_ONCE, Labeller, padded

#: Elements that make a block of their own; those whose content is no text; those without content.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript "
    "ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
UNREAD = frozenset("script style template svg math iframe object canvas audio video noembed noframes textarea".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the left ends open ones of the right, up to the nearest of its parents' kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "tbody": {"thead", "tr", "td", "th"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
#: What names tell: of elements, and of the words in their class, id and role.
MAIN_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "head", "button", "select", "noscript", "dialog", "menu"}
OTHER_WORDS = set(
    "nav navigation navbar menu breadcrumb breadcrumbs header masthead topbar footer bottom copyright legal sidebar aside widget related ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored "
    "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login search form share sharing social comment comments reply replies respond disqus pagination pager skip toolbar".split()
)

#: Sizes of the path's and the words' part of a vector. Pages of the sample, their characters together at most,
#: and blocks of a page that one step of the fit sees.
PATH, WORD, NUMBERS = 64, 48, 9
SIZE = PATH + WORD + NUMBERS
PAGES, CHARS, STEPS = 240, 4_000_000, 160
#: Other layouts of a sampled page.
LAYOUTS = 2
#: Blocks of pages that are labelled side by side.
WIDTH = 20_000

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """A leaf: its path ((tag, words), ...), text, and characters of it inside links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(dict.fromkeys(w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")))


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order; those without text are none."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = [("", ())]  # tag, path up to it
    said: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            if text:
                out.append(Block(stack[-1][1], text, min(linked, len(text))))
            said.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            said.append(text)
            if links:
                linked += len(text)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:  # an end
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                close()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        links = 0
                        break
        elif tag in UNREAD:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = at if m[3].endswith("/") else end.end() if end else n
        elif tag == "br":
            said.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCKS:
            close()
            if stack[-1][0] == "p":
                stack.pop()
            if tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ENDS[tag]:
                        del stack[k:]
                    elif stack[k][0] in WITHIN.get(tag, ()):
                        break
            if tag not in EMPTY:
                stack.append((tag, (stack[-1][1], (tag, _names(m[3])))))
                links = 0
    close()
    return out


def elements(path: tuple) -> Iterator[tuple[str, tuple[str, ...]]]:
    """The path's (tag, words), from the leaf up. A path is (parent's path, element), so that pages with deep
    nests share what they have in common."""
    while path:
        path, element = path
        yield element


def told(path: tuple) -> bool | None:
    """What the nearest telling element says; None if none does."""
    for tag, words in elements(path):
        if tag in OTHER_TAGS or OTHER_WORDS & set(words):
            return False
        if tag in MAIN_TAGS:
            return True
    return None


# -- vectors -----------------------------------------------------------------------------------
_TABLE = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint64)


def _token(token: str) -> np.ndarray:
    """A token's vector: four places of the path's part, up or down."""
    rng = random.Random(token)
    v = np.zeros(PATH, np.float32)
    for _ in range(4):
        v[rng.randrange(PATH)] += rng.choice((-0.5, 0.5))
    return v


class Paths:
    """Vectors of paths, kept while a task runs over pages of one kind; long tables start anew."""

    def __init__(self) -> None:
        self.token: dict[str, np.ndarray] = {}
        self.sums: dict[tuple, np.ndarray] = {}

    def _of(self, token: str) -> np.ndarray:
        if token not in self.token:
            if len(self.token) > 20_000:
                self.token.clear()
            self.token[token] = _token(token)
        return self.token[token]

    def vector(self, path: tuple) -> np.ndarray:
        """Sums of all elements' tokens, squashed, and the leaf's own tag once more."""
        if not path:
            return np.zeros(PATH, np.float32)
        if path not in self.sums:
            if len(self.sums) > 20_000:
                self.sums.clear()
            missing = [path]
            while missing[-1][0] and missing[-1][0] not in self.sums:
                missing.append(missing[-1][0])
            for p in reversed(missing):
                parent, (tag, words) = p
                total = self.sums[parent].copy() if parent else np.zeros(PATH, np.float32)
                for token in (tag, *("." + w for w in words)):
                    total += self._of(token)
                self.sums[p] = total
        tag = path[1][0]
        return np.tanh(self.sums[path]) + 0.5 * self._of("leaf " + tag)


def word_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each text, square roots of their shares, and the number of words. No text is empty."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b" ".join(raw), np.uint8)
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    begins = np.concatenate(([0], np.flatnonzero(flat == 32) + 1))
    begins = begins[(begins < len(flat))]
    begins = begins[flat[begins] != 32]
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(begins, np.diff(np.concatenate((begins, [len(flat)])))).astype(np.uint64)
    value = np.where(flat == 32, np.uint64(0), _TABLE[flat] * (2 * place + np.uint64(1)))
    h = np.add.reduceat(value, begins)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((h >> np.uint64(32)) % np.uint64(WORD)).astype(np.int64)
    of = np.searchsorted(starts, begins, "right") - 1
    counts = np.bincount(of * WORD + bucket, minlength=len(texts) * WORD).reshape(len(texts), WORD)
    total = counts.sum(1)
    return np.sqrt(counts / np.maximum(total, 1)[:, None]).astype(np.float32), total


def vectors(page: list[Block], paths: Paths) -> np.ndarray:
    """A row per block."""
    out = np.zeros((len(page), SIZE), np.float32)
    if page:
        texts = [b.text for b in page]
        out[:, PATH : PATH + WORD], words = word_vectors(texts)
        size = np.array([len(t) for t in texts], float)
        linked = np.array([b.linked for b in page]) / size
        marks = np.array([sum(map(t.count, ".,;:!?")) for t in texts]) / np.maximum(words, 1)
        ends = np.array([t[-1] in ".!?…" for t in texts])
        upper = np.array([t[0].isupper() for t in texts])
        place = (np.arange(len(page)) + 0.5) / len(page)
        for k, b in enumerate(page):
            out[k, :PATH] = paths.vector(b.path)
        numbers = (np.log1p(size) / 6, np.log1p(words) / 5, linked, np.minimum(marks, 2), ends, upper, place, 1 / (1 + np.arange(len(page))), np.full(len(page), np.log1p(len(page)) / 5))
        out[:, PATH + WORD :] = np.stack(numbers, 1)
    return out


# -- the fit -----------------------------------------------------------------------------------
#: Other names that a layout may have for an element, and parts that it may add: (elements, sayings, links).
_MAIN_TAGS, _MAIN_WORDS = ("main", "article", "div", "div", "section", "td"), ("content", "post", "entry", "story", "article", "body", "main", "text", "page")
_LEAVES = ("blockquote", "li", "div", "h2", "h3", "pre", "td", "figcaption")
_MENU_NAMES = [("div", ("menu",)), ("ul", ("navbar",)), ("div", ("navigation",)), ("header", ()), ("div", ("header",)), ("nav", ()), ("div", ())]
_FOOT_NAMES = [("div", ("footer",)), ("div", ("bottom",)), ("div", ("copyright",)), ("footer", ()), ("div", ())]
_AD_NAMES = [("div", ("ad",)), ("div", ("banner",)), ("div", ("promo",)), ("aside", ("sponsored",)), ("div", ("advert",)), ("div", ())]
_BEFORE = [
    ([("div", ("cookie", "notice"))], ["We use cookies to improve this site.", "Accept all", "Settings"], False),
    ([("header", ())], ["Home", "News", "About us", "Contact"], True),
    ([("div", ("breadcrumb",))], ["Home", "Archive", "Articles"], True),
    ([("form", ("search",))], ["Search this site", "Go"], False),
    ([("aside", ("sidebar",))], ["Most read", "Latest news", "Popular now"], True),
]
_AFTER = [
    ([("aside", ("sidebar",))], ["Most read", "Latest news", "Popular now"], True),
    ([("div", ("related",))], ["Related articles", "Read more", "See also"], True),
    ([("div", ("share", "social"))], ["Share this", "Tweet", "Send by mail"], True),
    ([("form", ("newsletter", "signup"))], ["Subscribe to our newsletter", "Your mail address", "Sign up"], False),
    ([("form", ("login",))], ["Log in", "Password", "Leave a comment"], False),
]
_COMMENTS = [[("section", ("comments",))], [("div", ("comment", "list")), ("div", ("comment",))], [("ol", ("comments",)), ("li", ("comment",))], [("div", ("disqus", "thread"))]]


def _path(elements_: list[tuple[str, tuple[str, ...]]], start: tuple = ()) -> tuple:
    for e in elements_:
        start = (start, e)
    return start


def layout(page: list[Block], labels: list[bool], prose: list[str], rng: random.Random) -> tuple[list[Block], list[bool]]:
    """The page in another layout: see the module's docstring. prose: texts of other pages' main blocks."""
    names = {"main": (rng.choice(_MAIN_TAGS), tuple(rng.sample(_MAIN_WORDS, rng.randint(0, 2)))), "nav": rng.choice(_MENU_NAMES), "footer": rng.choice(_FOOT_NAMES), "ad": rng.choice(_AD_NAMES)}

    def kind(tag: str, words: tuple[str, ...]) -> str | None:
        return "main" if tag in MAIN_TAGS else "nav" if tag == "nav" else "footer" if tag == "footer" else "ad" if {"ad", "ads", "advert"} & set(words) else None

    noise = {tag: (f"x{rng.randrange(1000)}",) for tag in ("html", "body", "div", "ul", "p", "li", "main", "section", "h1") if rng.random() < 0.2}

    def renamed(path: tuple) -> tuple:
        out = [names.get(kind(*e), e) if kind(*e) else e for e in reversed(list(elements(path)))]
        if out[-1][0] == "p" and rng.random() < 0.15:
            out[-1] = rng.choice(_LEAVES), ()
        return _path([(tag, (*words, *noise.get(tag, ()))) for tag, words in out])

    def group(parts_, sayings, link) -> list[Block]:
        texts = [rng.choice(sayings) if rng.random() < 0.5 else " ".join(rng.choice(prose).split()[: rng.randint(1, 6)]) for _ in range(rng.randint(1, 5))]
        inner = [("ul", ()), ("li", ())] if link else [("p", ())] * rng.randint(0, 1)
        head = rng.random() < 0.4
        leaf = lambda k: [("h3", ())] if head and not k else inner
        return [Block(_path([("html", ()), ("body", ()), *parts_, *leaf(k)]), t, len(t) if link and not (head and not k) else 0) for k, t in enumerate(texts) if t]

    def comments() -> list[Block]:
        where = rng.choice(_COMMENTS)
        return [Block(_path([("html", ()), ("body", ()), *where, ("p", ())]), rng.choice(prose), 0) for _ in range(rng.randint(1, 6))]

    moved = [(Block(renamed(b.path), b.text, b.linked), y) for b, y in zip(page, labels, strict=True)]
    head = [(b, y) for b, y in moved if told(b.path) is False and "head" in [e[0] for e in elements(b.path)]]
    rest = moved[len(head) :]
    before = [(b, False) for g in rng.sample(_BEFORE, rng.randint(0, 2)) for b in group(*g)]
    after = [(b, False) for g in rng.sample(_AFTER, rng.randint(0, 2)) for b in group(*g)] + [(b, False) for b in (comments() if rng.random() < 0.4 else [])]
    last = max((k for k, (_, y) in enumerate(rest) if y), default=len(rest) - 1) + 1
    out = head + before + rest[:last] + after + rest[last:]
    return [b for b, _ in out], [y for _, y in out]


def fit(pages: list[str], rounds: int | None = None, seed: int = 0) -> Labeller | None:
    """A labeller of the pages whose markup tells the main text; None if there is no such page."""
    rng, known = random.Random(seed), []
    for html in pages:
        page = blocks(html)
        labels = [told(b.path) is True for b in page]
        if any(labels):
            known.append((page, labels))
    if not known:
        return None
    prose = [b.text for page, labels in known for b, y in zip(page, labels, strict=True) if y]
    paths, rows, truth = Paths(), [], []
    for page, labels in known:
        for form in ((page, labels), *(layout(page, labels, prose, rng) for _ in range(LAYOUTS))):
            x, y = vectors(form[0], paths), np.array(form[1], np.float32)
            for k in range(0, len(x), STEPS):
                rows.append(x[k : k + STEPS])
                truth.append(y[k : k + STEPS])
    net = Labeller(SIZE, seed=seed)
    net.fit(rows, truth, **({"rounds": rounds} if rounds else {}), seed=seed)
    return net


def label(net: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """For each page whether its blocks are main text; pages of like length go side by side."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
    while order:
        n = max(1, min(len(order), 4 * AT_ONCE, WIDTH // len(pages[order[-1]])))
        group, order = order[-n:], order[:-n]
        margin, _ = net.margins(*padded([pages[i] for i in group]))
        for k, i in enumerate(group):
            out[i] = margin[k, : len(pages[i])] > 0
    return out


def main_texts(net: Labeller, pages: list[str], paths: Paths) -> list[str]:
    read = [blocks(p) for p in pages]
    chosen = label(net, [vectors(p, paths) for p in read])
    return [" ".join(b.text for b, y in zip(p, c, strict=True) if y) for p, c in zip(read, chosen, strict=True)]


def sample_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """PAGES whole pages at most, of CHARS characters together (but for the last one), by a hash of the id."""
    ids = pages.select(column(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(PAGES)
    some = pages.select(column(id_col).alias("id"), F.coalesce(column(html_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")  # PAGES ids at most
    one = written(some.groupBy("id").agg(F.min("text").alias("text")), "sampled-pages").withColumn("size", F.length("text"))
    taken, size = [], 0
    for r in sorted(one.select("id", "size", F.xxhash64("id").alias("h")).collect(), key=lambda r: (r["h"], r["id"])):
        if size < CHARS:
            taken.append(r["id"])
            size += r["size"]
    return [r["text"] for r in sorted(one.filter(F.col("id").isin(taken)).collect(), key=lambda r: r["id"])] if taken else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """A row per page: page_id, url, text (the main text), n_chars. Without ``net`` one is fitted to a sample of
    the pages. Only the three named columns are read."""
    net = net or fit(sample_pages(pages, id_col, html_col))
    sent = pages.sparkSession.sparkContext.broadcast(net)
    rows = pages.select(column(id_col).alias("page_id"), column(url_col).alias("url"), column(html_col).cast("string").alias("text"))
    shape = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for b, texts in parts(batches):
            made = main_texts(sent.value, texts, paths) if sent.value else [""] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, shape)
