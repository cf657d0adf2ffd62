"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks: the text between block-level tags, with the tags and
attribute names of its ancestors. Features of the ancestors and the text feed a two-label
chain (content, boilerplate) that is trained by gradient ascent on labelled pages and
decoded by Viterbi. Labelled pages are made from a bounded sample of the pages at hand:
their own structure labels their blocks, and re-rendered layouts of the same texts show
menus, sidebars, notices, forms and comments in other clothes.
"""

from __future__ import annotations

import html
import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed word lists: names in tags, classes, ids and roles that tell content from page furniture.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul br textarea".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template head title object iframe canvas select textarea button datalist audio video".split())
HEAD_TAGS = frozenset("base head link meta noscript script style template title".split())
UNCLOSED_TAGS = frozenset("button select option textarea datalist title".split())
FURNITURE_TAGS = frozenset("nav footer aside form header menu dialog".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split())}
FURNITURE_WORDS = (
    "ad ads adv advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead top footer foot bottom copyright legal "
    "sidebar side aside widget related recommended popular trending more share social follow subscribe newsletter signup login form search filter comment comments "
    "comentarios kommentare commentaires discussion reply replies respond disqus cookie cookies consent notice notices alert gdpr popup modal overlay toolbar pager pagination tags meta byline hidden skip"
).split()
CONTENT_WORDS = "article content post entry story main body text page prose article-body post-content entry-content maincontent".split()
ARTICLE_NAMES = frozenset("article content post story entry".split())
TRAIN_PAGES = 400
#: Longest html of a training page; longer pages are extracted, but not learned from.
TRAIN_BYTES = 65536
#: Pages rendered around loose words, so that a chain is trained whatever the pages show.
PLAIN_LAYOUTS = 120
EPOCHS = 30
STEP = 0.5
DECAY = 1e-3
SEED = 7


class Blocks(HTMLParser):
    """Leaf blocks of a page: (text, ancestor tags, ancestor names, link characters)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[tuple[str, tuple, int]] = []
        self.parts: list[str] = []
        self.links = 0
        self.hidden = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, tuple(self.stack), self.links))
        self.parts, self.links = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.hidden:
            self._show(tag)
        if tag in BLOCK_TAGS:
            self._flush()
            if any(t == "p" for t, _ in self.stack) and tag in CLOSED_BY["p"]:
                self._close("p", stop=FURNITURE_TAGS | {"div", "article", "section", "main", "td", "li", "body"})
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                self._close(tag, stop=frozenset("ul ol dl table tr select menu".split()))
        elif tag in HIDDEN_TAGS:
            self._flush()
        if tag in VOID_TAGS:
            return
        names: list[str] = []
        for key, value in attrs:
            if key in ("class", "id", "role", "aria-label") and value:
                names += re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and "display:none" in value.replace(" ", "")):
                names.append("hidden")
        self.stack.append((tag, tuple(n for n in names if n)))
        self.hidden += tag in HIDDEN_TAGS

    def _show(self, tag: str) -> None:
        """Close hidden elements whose end tags were left out: a head at content, a control at a block of text."""
        if tag not in HEAD_TAGS and any(t == "head" for t, _ in self.stack):
            self._close("head")
        if tag in BLOCK_TAGS - HIDDEN_TAGS - {"option"}:
            for t, _ in list(self.stack):
                if t in UNCLOSED_TAGS:
                    self._close(t)
                    break
        if tag in ("article", "main", "body"):
            for t in HIDDEN_TAGS:
                self._close(t)

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                for t, _ in self.stack[k:]:
                    self.hidden -= t in HIDDEN_TAGS
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
            self._flush()
        self._close(tag, stop=frozenset() if tag in BLOCK_TAGS | HIDDEN_TAGS else BLOCK_TAGS)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if any(t == "a" for t, _ in self.stack[-3:]):
                self.links += len(data.strip())


def leaf_blocks(page: str | None) -> list[tuple[str, tuple, int]]:
    """Visible leaf blocks in page order; scripts, styles and form controls are no blocks."""
    parser = Blocks()
    parser.feed(page or "")
    parser.close()
    parser._flush()
    return parser.blocks


FEATURES = {name: i for i, name in enumerate(
    ["bias", "first", "last", "furniture_tag", "furniture_name", "content_tag", "content_name", "comment_name", "ad_name", "in_p", "in_heading", "in_li", "in_td", "in_form",
     "in_blockquote", "links_all", "links_half", "no_links", "len_1", "len_25", "len_80", "len_250", "ends_sentence", "has_sentence", "copyright", "pipe", "depth_3", "depth_6",
     "same_parent", "hidden", "furniture_after_content", "bare_div", "short_in_list"]
)}
_FURNITURE = frozenset(FURNITURE_WORDS)
_CONTENT = frozenset(CONTENT_WORDS)
_COMMENT = frozenset("comment comments comentarios kommentare commentaires discussion reply replies respond disqus".split())
_AD = frozenset("ad ads adv advert advertisement sponsor sponsored promo banner".split())


def _active(blocks: list[tuple[str, tuple, int]]) -> list[list[int]]:
    """Indices of the features that hold, block by block."""
    out = []
    seen_content, before = False, None
    for i, (text, stack, links) in enumerate(blocks):
        tags = [t for t, _ in stack]
        names = {n for _, own in stack for n in own if True}
        deep = {n for _, own in stack[2:] for n in own}
        n = len(text)
        has = {
            "bias": True, "first": i == 0, "last": i == len(blocks) - 1,
            "furniture_tag": any(t in FURNITURE_TAGS for t in tags) and not ("header" in tags and "article" in tags[: tags.index("header")]),
            "furniture_name": bool(deep & _FURNITURE), "content_tag": "article" in tags or "main" in tags, "content_name": bool(deep & _CONTENT) and not deep & _FURNITURE,
            "comment_name": bool(names & _COMMENT), "ad_name": bool(names & _AD), "in_p": "p" in tags, "in_heading": any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in tags),
            "in_li": "li" in tags, "in_td": "td" in tags, "in_form": "form" in tags or "label" in tags, "in_blockquote": "blockquote" in tags,
            "links_all": links >= 0.8 * n, "links_half": 0.3 * n <= links < 0.8 * n, "no_links": links == 0,
            "len_1": n < 25, "len_25": 25 <= n < 80, "len_80": 80 <= n < 250, "len_250": n >= 250,
            "ends_sentence": text[-1] in ".!?…»\"”:", "has_sentence": ". " in text or ", " in text, "copyright": "©" in text or "copyright" in text.lower() or "all rights" in text.lower(), "pipe": "|" in text and n < 120,
            "depth_3": len(tags) <= 3, "depth_6": len(tags) >= 6, "same_parent": before is not None and before == stack[:-1], "hidden": "hidden" in names,
            "furniture_after_content": seen_content and bool(deep & _FURNITURE), "bare_div": bool(tags) and tags[-1] in ("div", "body", "span") and not deep, "short_in_list": n < 40 and "li" in tags,
        }
        seen_content |= has["content_tag"] or n >= 250
        before = stack[:-1]
        out.append([FEATURES[k] for k, v in has.items() if v])
    return out


class Chain:
    """Two-label linear-chain CRF; label 1 is content."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((len(FEATURES), 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def potentials(self, active: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[a].sum(axis=0) for a in active]).reshape(-1, 2)

    def viterbi(self, active: list[list[int]]) -> list[int]:
        """Labels of the best path; ties go to boilerplate."""
        if not active:
            return []
        scores = self.potentials(active)
        best, back = scores[0], []
        for row in scores[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        path = [int(best.argmax())]
        for pointer in reversed(back):
            path.append(int(pointer[path[-1]]))
        return path[::-1]

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(scores)
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = scores[0]
        for i in range(1, n):
            fore[i] = np.logaddexp(fore[i - 1][0] + self.move[0], fore[i - 1][1] + self.move[1]) + scores[i]
        for i in range(n - 2, -1, -1):
            step = self.move + scores[i + 1] + aft[i + 1]
            aft[i] = np.logaddexp(step[:, 0], step[:, 1])
        z = np.logaddexp(*fore[-1])
        single = np.exp(fore + aft - z)
        pair = np.exp(fore[:-1, :, None] + self.move + (scores[1:] + aft[1:])[:, None, :] - z) if n > 1 else np.zeros((0, 2, 2))
        return single, pair

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Chain:
        """Maximise the penalised likelihood of labelled pages by Adagrad in a fixed order."""
        rng = random.Random(SEED)
        seen_e, seen_m = np.full(self.emit.shape, 1e-2), np.full(self.move.shape, 1e-2)
        for _ in range(epochs):
            for active, labels in rng.sample(pages, len(pages)):
                if not active:
                    continue
                single, pair = self._marginals(self.potentials(active))
                single = -single
                single[np.arange(len(labels)), labels] += 1
                ge, gm = -DECAY * self.emit, -DECAY * self.move - pair.sum(axis=0)
                for a, row in zip(active, single, strict=True):
                    ge[a] += row
                np.add.at(gm, (labels[:-1], labels[1:]), 1)
                seen_e += ge**2
                seen_m += gm**2
                self.emit += STEP * ge / np.sqrt(seen_e)
                self.move += STEP * gm / np.sqrt(seen_m)
        return self


def _labels_by_structure(blocks: list[tuple[str, tuple, int]]) -> list[int] | None:
    """Labels of a page whose structure names its article, by a tag, a role or a name; None where it doesn't.

    The content starts at the outermost article; without one at main, then at role main,
    then at a name that only the main text has.
    """
    marks = (lambda t, n: t == "article", lambda t, n: t == "main", lambda t, n: "main" in n and "menu" not in n, lambda t, n: bool(ARTICLE_NAMES & set(n)))
    for mark in marks:
        at = [next((k for k, (t, n) in enumerate(stack) if t != "body" and mark(t, n)), None) for _, stack, _ in blocks]
        if any(k is not None for k in at):
            return [int(k is not None and not FURNITURE_TAGS & {t for t, _ in stack[k:]}) for k, (_, stack, _) in zip(at, blocks, strict=True)]
    return None


def _rendered(title: str, paragraphs: list[str], spare: list[str], rng: random.Random) -> tuple[str, set[str]]:
    """A page of another layout around the same text, and its content texts."""
    esc = lambda x: html.escape(x, quote=False)
    few = lambda k: " ".join(rng.choices(spare, k=k))
    links = lambda k: "".join(f'<li><a href="/{i}">{esc(few(rng.randint(1, 3)))}</a></li>' for i in range(k))
    word = rng.choice
    before = [
        f'<div class="{word(["menu", "navbar", "top-nav", "main-menu"])}"><ul>{links(5)}</ul></div>', f"<nav><ul>{links(6)}</ul></nav>",
        f'<header class="{word(["site-header", "masthead", "page-header"])}"><a href="/">{esc(few(2))}</a><p>{esc(few(6))}</p></header>',
        f'<div class="{word(["cookie-notice", "consent-banner", "notice", "alert"])}"><p>{esc(few(14))}.</p></div>', f'<div class="{word(["ad", "advert", "sponsored", "promo-box"])}">{esc(few(8))}.</div>',
        f'<div id="{word(["breadcrumb", "breadcrumbs"])}"><a href="/">{esc(few(1))}</a> &gt; <a href="/x">{esc(few(1))}</a></div>', f'<form action="/s"><label>{esc(few(2))}</label><input name="q"><p>{esc(few(5))}</p></form>',
    ]
    after = [
        f'<aside class="{word(["sidebar", "related", "widget"])}"><h3>{esc(few(2))}</h3><ul>{links(4)}</ul><p>{esc(few(25))}.</p></aside>', f'<div class="{word(["sidebar", "side-bar", "related-posts", "recommended"])}"><h3>{esc(few(2))}</h3><p>{esc(few(18))}.</p></div>',
        f'<section class="{word(["comments", "comment-list", "discussion"])}"><h3>{esc(few(1))}</h3>' + "".join(f'<div class="comment"><b>{esc(few(1))}</b><p>{esc(few(rng.randint(8, 40)))}.</p></div>' for _ in range(3)) + "</section>",
        f'<div id="{word(["comments", "disqus_thread", "respond"])}"><p>{esc(few(30))}.</p><p>{esc(few(12))}.</p></div>', f"<footer><p>&copy; {esc(few(5))}.</p><ul>{links(3)}</ul></footer>", f'<div class="{word(["footer", "site-footer", "copyright"])}">&copy; 2020 {esc(few(4))}.</div>',
        f'<div class="{word(["newsletter", "subscribe", "share"])}"><p>{esc(few(10))}.</p><form><input name="e"></form></div>', f'<div class="{word(["ads", "banner", "advertisement"])}"><p>{esc(few(15))}.</p></div>',
    ]
    wrap = word(['<article class="post">|</article>', '<main>|</main>', '<div class="content">|</div>', '<div id="main-content">|</div>', '<div class="entry-content">|</div>', '<div class="post-body">|</div>', "<div>|</div>", '<section class="story">|</section>', '<main><article>|</article></main>'])
    inner = [f"<p>{esc(p)}</p>" for p in paragraphs]
    if len(inner) > 2 and rng.random() < 0.4:
        inner.insert(rng.randint(1, len(inner) - 1), word(before[3:5] + after[-2:]))
    content = {title, *paragraphs}
    body = wrap.replace("|", f"<h1>{esc(title)}</h1>" + "".join(inner))
    page = "".join(rng.sample(before, rng.randint(1, 4))) + body + "".join(rng.sample(after, rng.randint(1, 4)))
    return f"<html><head><title>{esc(title)}</title></head><body>{page}</body></html>", content


def labelled_pages(pages: list[str]) -> list[tuple[list[list[int]], list[int]]]:
    """Training sequences from pages whose structure names the article, and from layouts rendered around their texts."""
    rng = random.Random(SEED)
    parsed = [leaf_blocks(p) for p in pages]
    spare = [w for blocks in parsed for text, _, _ in blocks for w in text.split()[:30]] or ["x"]
    out = []
    for blocks in parsed:
        if (labels := _labels_by_structure(blocks)) is None:
            continue
        out.append((_active(blocks), labels))
        content = [t for (t, _, _), y in zip(blocks, labels, strict=True) if y]
        for _ in range(2):
            if content:
                page, texts = _rendered(content[0], content[1:], spare, rng)
                texts = {" ".join(t.split()) for t in texts}
                again = leaf_blocks(page)
                out.append((_active(again), [int(t in texts) for t, _, _ in again]))
    few = lambda low, high: " ".join(rng.choices(spare, k=rng.randint(low, high)))
    for _ in range(PLAIN_LAYOUTS):
        page, texts = _rendered(few(2, 8), [f"{few(8, 40)}, {few(5, 30)}." for _ in range(rng.randint(2, 7))], spare, rng)
        texts = {" ".join(t.split()) for t in texts}
        again = leaf_blocks(page)
        out.append((_active(again), [int(t in texts) for t, _, _ in again]))
    return out


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Chain:
    """A chain fitted on at most `most` pages, those of the smallest hashes of their html."""
    keyed = pages.filter(f"html is not null and octet_length(html) < {TRAIN_BYTES}").select("html", F.xxhash64("html", F.lit(SEED)).alias("key"))
    last = keyed.select("key").distinct().orderBy("key").limit(most).agg(F.max("key")).first()[0]
    sample = keyed.filter(F.col("key") <= last).dropDuplicates(["key"]).orderBy("key") if last is not None else keyed.limit(0)
    return Chain().fit(labelled_pages([r.html for r in sample.collect()]))


def extract(page: str | None, chain: Chain) -> str:
    """Content blocks of one page, joined by a space. Without markup, the whole text is content."""
    blocks = leaf_blocks(page)
    if blocks and all(not stack for _, stack, _ in blocks):
        return " ".join(t for t, _, _ in blocks)
    return " ".join(t for (t, _, _), y in zip(blocks, chain.viterbi(_active(blocks)), strict=True) if y)


def main_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Character references are decoded; white space inside a block becomes one space.
    Null and empty html gives an empty text; repeated rows are read each; html of any
    length is read whole. Other columns are ignored.
    """
    chain = train(pages) if chain is None else chain
    emit, move = chain.emit, chain.move

    def run(batches):
        model = Chain(emit, move)
        for batch in batches:
            texts = [extract(p, model) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
