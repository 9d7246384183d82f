"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element has a hidden label, content or not. An element's features bear on its own label (tag, share of
link text, words of class, id and role, how much text is in it and in it directly, its share of the page's
text, paragraphs and form fields in it), and parent-child potentials bind its label to its parent's, by the
kind of the child and whether the parent is the page's body. Sum-product messages, first from the leaves up
and then from the root down, give each element's exact marginal; text that stands directly in elements
whose marginal is above one half is the main text. The weights of both are fitted together, by gradient
steps on the likelihood of the labelled pages of labelled_pages(), whose expectations are the same two
passes; the model is some thousand numbers, which go to the tasks. Furniture inside an article is common
there, so the potentials let it be without turning the article. Pages are judged where they are, with no
shuffle, each in time linear in its elements.

Defined results: null or empty html, and pages without content, have an empty text; a marginal of exactly
one half is not content; markup that is cut off at the end is dropped; end tags without a start are
ignored, and elements that are not closed end with their container; very deep markup and very long pages
are read without recursion, whole; repeated rows return a row each; an empty table gives no rows; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import random
import re
from array import array
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pieces, trimmed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements whose text is never shown as text.
SILENT = frozenset("script style noscript template head title iframe object canvas svg textarea select button".split())
#: A start tag ends an open element of these kinds, if no element of the second kinds is in between.
_ENDS = {
    **{t: (frozenset({"p"}), frozenset({"td", "th", "table", "button", "object"})) for t in BLOCK},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    **{t: (frozenset({"dt", "dd", "p"}), frozenset({"dl"})) for t in ("dt", "dd")},
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    **{t: (frozenset({"td", "th"}), frozenset({"table", "tr"})) for t in ("td", "th")},
    **{t: (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})) for t in ("tbody", "thead", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select"})),
}
PARAGRAPH = frozenset("p pre blockquote li dd td".split())
FIELD = frozenset("input textarea select button label option".split())
INLINE = frozenset("a b i em strong span code small sub sup u s q cite abbr time mark font img kbd samp var del ins br".split())
#: Kinds of children for the parent-child potentials; others are of the last kind.
KINDS = (frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th figure figcaption hr address".split()), INLINE, frozenset("div section main article center".split()), frozenset("nav header footer aside form fieldset menu dialog button label".split()), SILENT, frozenset())
STEPS = 200
PENALTY = 0.5
_WORD = re.compile(r"[a-z]+")


class Dom(HTMLParser):
    """Elements in document order, parents before children, and the text between tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words, self.mark = [-1], ["#root"], [()], [None]
        self.text: list[tuple[int, str]] = []  # (element, text); text None: a block starts or ends
        self.open = [0]

    def handle_starttag(self, tag: str, attrs) -> None:
        rule = _ENDS.get(tag)
        if rule and len(self.open) > 1:
            ends, stops = rule
            last = None
            for k in range(len(self.open) - 1, 0, -1):
                name = self.tag[self.open[k]]
                if name in ends:
                    last = k
                elif name in stops or (tag not in ("li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option") and name in BLOCK):
                    break
            if last is not None:
                del self.open[last:]
        if tag in BLOCK:
            self.text.append((-1, ""))
        elif tag in ("br", "hr"):
            self.text.append((self.open[-1], " "))
        words, mark = [], None
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                words += _WORD.findall(v.lower())
            elif k == "data-y":
                mark = v == "1"
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.words.append(tuple(words))
        self.mark.append(mark)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use", "rect", "circle") and self.open[-1] == len(self.tag) - 1:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.text.append((-1, ""))
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.text.append((self.open[-1], data))


_CUT = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


def parse(html: str) -> Dom:
    dom = Dom()
    cut = _CUT.search(html, max(0, html.rfind("<"))) if "<" in html else None
    dom.feed(html[: cut.start()] if cut else html)
    dom.close()
    return dom


def features(dom: Dom):
    """Feature names of each element, one element after the other."""
    n = len(dom.tag)
    size, linked, paragraphs, fields = [0] * n, [0] * n, [0] * n, [0] * n
    for at, text in dom.text:
        if at >= 0 and dom.tag[at] not in SILENT:
            size[at] += len(text.strip())
    own = size.copy()
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        if dom.tag[i] == "a":
            linked[i] = size[i]
        paragraphs[i] += dom.tag[i] in PARAGRAPH and size[i] >= 40
        fields[i] += dom.tag[i] in FIELD
        size[p] += size[i]
        linked[p] += linked[i]
        paragraphs[p] += paragraphs[i]
        fields[p] += fields[i]
    for i in range(n):
        tag, share = dom.tag[i], -1 if not size[i] else min(3, 4 * linked[i] // size[i])
        names = [f"tag={tag}", f"links={share}", f"tag={tag},links={share}", f"fields={fields[i] > 0},{size[i] > 200}", f"tag={tag},own={own[i] > 20}"]
        names += [f"own>{k}" for k in (0, 40, 150) if own[i] > k] + [f"size>{k}" for k in (25, 100, 400) if size[i] > k]
        names += [f"paragraphs>{k}" for k in (0, 1, 3) if paragraphs[i] > k] + [f"part>{k}" for k in (1, 2, 3) if 4 * size[i] > k * size[0]]
        yield names + [f"word={w}" for w in dict.fromkeys(dom.words[i])]


_KIND = {t: k for k, tags in enumerate(KINDS) for t in tags}
#: The kind of elements within a line that have no name: they have their parent's label, all but surely.
PLAIN = len(KINDS)
SAME = ((0.0, -12.0), (-12.0, 0.0))


class Forest:
    """The elements of several pages as arrays, by depth, for messages of whole levels."""

    def __init__(self, doms: list[Dom], number: dict[str, int], grow: bool = False):
        parent, depth, kind, at, who = (array("q") for _ in range(5))
        self.first = []
        for dom in doms:
            base = len(parent)
            self.first.append(base)
            for i, (p, tag) in enumerate(zip(dom.parent, dom.tag)):
                parent.append(base + max(p, 0))
                depth.append(depth[base + p] + 1 if i else 0)
                k = PLAIN if tag in INLINE and not dom.words[i] else _KIND.get(tag, len(KINDS) - 1)
                kind.append(2 * k + (i > 0 and dom.tag[p] in ("body", "html", "#root")))
            for i, names in enumerate(features(dom)):
                if dom.tag[i] in SILENT:  # never text, wherever it stands: tells nothing
                    continue
                for f in names:
                    x = number.setdefault(f, len(number)) if grow else number.get(f)
                    if x is not None:
                        at.append(x)
                        who.append(base + i)
        self.parent, self.kind, self.at, self.who = (np.array(x, np.int64) for x in (parent, kind, at, who))
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)
        self.silent = (self.kind // 2) == KINDS.index(SILENT)


class Model:
    """number: the weight that a feature has; weights; step[kind][parent][child]: potentials, as logarithms."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, step: np.ndarray):
        self.number, self.weights, self.step = number, weights, step

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each element, by sum-product up and down the trees, and for each that has a
        parent P(parent, element)."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(forest.who, self.weights[forest.at], minlength=n)
        step = np.where(forest.silent[:, None, None], 0.0, self.step[forest.kind])
        up = np.zeros((n, 2))
        for level in forest.levels[:0:-1]:
            up[level] = np.logaddexp(step[level, :, 0] + own[level, :1], step[level, :, 1] + own[level, 1:])
            np.add.at(own, forest.parent[level], up[level])
        belief, joint = own.copy(), np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            others = belief[forest.parent[level]] - up[level]
            both = others[:, :, None] + step[level] + own[level, None, :]
            joint[level] = both
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
        joint = np.exp(joint - np.logaddexp(belief[:, 0], belief[:, 1])[:, None, None])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def fit(pages: list[str]) -> Model:
    """Weights under which the labels of the pages are likely: an element's data-y says whether it is
    content; others are like their parent. Resilient gradient steps, the same on every run."""
    doms, number = [parse(h) for h in pages], {}
    forest = Forest(doms, number, grow=True)
    y = np.concatenate([_labels(d) for d in doms]).astype(float)
    told = ~forest.silent
    told[forest.first] = False
    model = Model(number, np.zeros(len(number)), np.zeros((2 * len(KINDS) + 2, 2, 2)))
    model.step[2 * PLAIN :] = SAME
    truth = np.zeros((len(y), 2, 2))
    truth[np.arange(len(y)), y[forest.parent].astype(int), y.astype(int)] = 1
    rate, before = np.full(len(number) + model.step.size, 0.1), 0
    for _ in range(STEPS):
        p, joint = model.marginals(forest)
        g = np.bincount(forest.at, (y - p)[forest.who], minlength=len(number)) - PENALTY * model.weights
        d = (truth - joint)[told]
        h = np.zeros_like(model.step)
        np.add.at(h, forest.kind[told], d)
        h[2 * PLAIN :] = PENALTY * model.step[2 * PLAIN :]  # stays
        now = np.concatenate([g, (h - PENALTY * model.step).reshape(-1)])
        rate = np.clip(np.where(now * before > 0, rate * 1.2, np.where(now * before < 0, rate * 0.5, rate)), 1e-4, 0.5)
        move = np.sign(now) * rate
        model.weights = model.weights + move[: len(number)]
        model.step = model.step + move[len(number) :].reshape(model.step.shape)
        before = now
    return model


def _labels(dom: Dom) -> list[int]:
    label = [0] * len(dom.tag)
    label[0] = int("body" not in dom.tag)  # a labelled page without a body is a piece of a main text
    for i in range(1, len(label)):
        label[i] = label[dom.parent[i]] if dom.mark[i] is None else int(dom.mark[i])
    return label


def extract_all(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page: blocks in page order, joined by a line feed."""
    doms = [parse(h) if h else Dom() for h in pages]
    forest = Forest(doms, model.number)
    content = model.marginals(forest)[0] > 0.5
    return [_text(dom, content[i : i + len(dom.tag)].tolist()) for dom, i in zip(doms, forest.first)]


def extract(html: str | None, model: Model) -> str:
    return extract_all([html], model)[0]


def _text(dom: Dom, content: list[bool]) -> str:
    silent = [False] * len(content)
    for i in range(1, len(content)):
        silent[i] = silent[dom.parent[i]] or dom.tag[i] in SILENT
    blocks, now = [], []
    for at, text in dom.text:
        if at < 0:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif content[at] and not silent[at]:
            now.append(text)
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


# ---- labelled pages -----------------------------------------------------------------------------

_FILL = "the river runs past old mills and new houses while people of the town talk about prices weather and plans for a bridge that nobody has built yet".split()


class _Maker:
    """Parts of labelled pages; data-y marks content and what is not, where it differs from the parent."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(_FILL) for _ in range(self.r.randint(low, high))).capitalize() + self.r.choice([".", ".", "", "?"])

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{self.words(1, 3)}</a></{tag}>' for i in range(self.r.randint(2, 7)))

    def name(self, names: str) -> str:
        """Attributes of a piece of furniture that is called by one of the names."""
        n = self.r.choice(names.split())
        return self.r.choice([f'class="{n}"', f'id="{n}"', f'class="{n}"', f'class="{n} {self.r.choice(["box", "block", "inner", "wrap"])}"', f'class="site-{n}"'])

    def plain(self) -> str:
        """Attributes that say nothing."""
        r = self.r
        return r.choice(["", "", f'class="{r.choice("abcdefgh")}{r.randrange(99)}"', f'class="{r.choice(["row", "col", "box", "inner", "wrap", "wrapper", "container", "css", "grid", "block", "section", "page", "layout", "left", "right", "center"])}"'])

    def block(self) -> str:
        r, w = self.r, self.words
        text = w(*r.choice([(1, 2), (3, 9), (10, 30), (20, 50), (30, 80), (40, 120), (80, 250)]))
        return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p><p>{w(5, 60)}</p>", f'<p>{text} <a href="/x">{w(1, 4)}</a> {w(2, 12)}</p>', f"<h2>{w(2, 6)}</h2><p>{text}</p>", f"<h3>{w(2, 5)}</h3><p>{text}</p>", f"<ul><li>{text}</li><li><b>{w(1, 4)}</b> {w(3, 20)}</li></ul>", f"<ol><li><p>{text}</p></li><li>{w(2, 15)}</li></ol>", f"<p><b>{text}</b><br>{w(3, 20)}</p>", f"<p><b>{text}<br>", f"<blockquote><p><em>{text}</em></p></blockquote>", f"<table><tr><th>{w(1, 2)}</th><td>{text}</td></tr><tr><td>{w(1, 5)}</td><td><span>{w(1, 3)}</span></td></tr></table>", f'<p>{text}</p><p><a href="/y">{w(2, 8)}</a></p>', f"<div><p>{text}</p><figure><img src=x><figcaption>{w(3, 9)}</figcaption></figure></div>", f"<pre>{text}</pre>", f"<pre><code>{text}</code></pre>", f"<dl><dt>{w(1, 2)}</dt><dd>{text}</dd></dl>", f"<div>{text}</div>", f"<section><h2>{w(2, 5)}</h2><p>{text}</p></section>"])

    def furniture(self, mark: str = "") -> str:
        """What is not main text, of any kind, at any place."""
        r, w, n = self.r, self.words, self.name
        m, s = w(3, 16), w(1, 6)
        long = w(10, 34)
        return r.choice([
            f"<nav{mark}><ul>{self.links()}</ul></nav>", f"<div {n('menu nav navigation navbar breadcrumb breadcrumbs topbar toc pagination pager')}{mark}><ul>{self.links()}</ul></div>", f"<ul {n('menu nav breadcrumb tags pagination')}{mark}>{self.links()}</ul>",
            f"<header{mark}><h1>{s}</h1><p>{m}</p></header>", f"<header{mark}><a href=/>{s}</a><nav><ul>{self.links()}</ul></nav></header>", f"<div {n('header masthead banner topbar')}{mark}><a href=/>{s}</a><p>{m}</p></div>",
            f"<footer{mark}>&copy; {m}</footer>", f"<footer{mark}><p>{long}</p><ul>{self.links()}</ul></footer>", f"<div {n('footer copyright legal imprint colophon')}{mark}>&copy; {m}</div>", f"<footer{mark}><p>{m} &middot; {s}</p></footer>",
            f"<aside{mark}><p>{long}</p></aside>", f"<aside{mark}><h3>{s}</h3><ul>{self.links()}</ul></aside>", f"<div {n('sidebar widget aside related teaser recommended trending')}{mark}><h3>{s}</h3><p>{m}</p></div>", f"<div {n('related recommended more-stories read-more')}{mark}><h3>{s}</h3><ul>{self.links()}</ul></div>",
            f"<div {n('ad ads advert advertisement adsense sponsored sponsor promo promotion banner')}{mark}>{r.choice([m, long, f'<p>{m}</p>', f'<p><b>{s}</b> {m}</p>'])}</div>", f"<section {n('ad ads sponsored promo')}{mark}><p>{m}</p></section>", f"<p {n('ad ads sponsored')}{mark}>{m}</p>",
            f"<div {n('cookie cookies consent notice gdpr alert popup modal overlay paywall disclaimer')}{mark}><p>{r.choice([m, long])}</p><button>{s}</button></div>", f"<div role=\"{r.choice(['alert', 'dialog', 'banner', 'navigation', 'search', 'complementary', 'contentinfo'])}\"{mark}><p>{m}</p></div>", f"<p {n('notice disclaimer alert')}{mark}>{m}</p>", f"<dialog{mark}><p>{m}</p></dialog>",
            f"<form action=/s{mark}><label>{s}</label><input name=q><button>{s}</button></form>", f"<form{mark}><p>{m}</p><input name=mail></form>", f"<form{mark}><p>{long}</p><textarea></textarea><p>{s}</p></form>", f"<div {n('newsletter subscribe signup login search')}{mark}><form><p>{m}</p><input></form></div>", f"<div {n('newsletter subscribe signup')}{mark}><p>{m}</p></div>", f"<fieldset{mark}><legend>{s}</legend><label>{m}</label><input></fieldset>",
            f"<div {n('comments comment-list replies responses discussion disqus')}{mark}><h3>{s}</h3><div class=comment><p>{long}</p></div><div class=comment><b>{s}</b><p>{m}</p></div></div>", f"<section {n('comments replies discussion')}{mark}><h2>{s}</h2><p>{long}</p><p>{m}</p></section>", f"<ol {n('comments commentlist')}{mark}><li><p>{long}</p></li><li><p>{m}</p></li></ol>", f"<article {n('comment reply')}{mark}><p>{long}</p></article>", f"<div {n('comment reply')}{mark}><p>{r.choice([m, long])}</p></div>",
            f"<div {n('share social sharing follow meta byline tags author-links')}{mark}>{self.links('span')}</div>", f"<div {n('menu nav footer')}{mark}><table><tr><td><a href=/>{s}</a></td><td><a href=/b>{s}</a></td></tr></table></div>", f"<menu{mark}>{self.links()}</menu>",
            f"<div {self.plain()}{mark}><ul>{self.links()}</ul></div>", f"<div {self.plain()}{mark}>{self.links('span')}</div>", f"<div {self.plain()}{mark}><a href=/>{s}</a> <a href=/b>{w(1, 2)}</a></div>", f"<p{mark}><a href=/>{s}</a> | <a href=/b>{w(1, 2)}</a></p>", f"<div {n('sidebar aside widget')}{mark}><div {self.plain()}><p>{s}</p></div><ul>{self.links()}</ul><p>{long}</p></div>", f"<div {n('sidebar widget')}{mark}><p>{s}</p></div>",
            f"<section {n('related recommended more')}{mark}><h2>{s}</h2><article><a href=/>{m}</a></article><article><a href=/b>{s}</a></article></section>", 
            f"<script{mark}>var x='<p>{s}</p>';</script>", f"<style{mark}>p{{}}</style>", f"<noscript{mark}><p>{m}</p></noscript>",
        ])

    def page(self, only: int | None = None) -> str:
        r = self.r
        body = [f"<h1>{self.words(2, 9)}</h1>"] if r.random() < 0.75 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            body.append(self.block())
            if r.random() < 0.22:
                body.append(self.furniture(' data-y="0"'))
        if r.random() < 0.3:
            body.append(self.furniture(' data-y="0"'))
        if r.random() < 0.15:  # verse, dialogue, long lists: nothing but short lines
            line = r.choice(["<p>{}</p>", "<p>{}</p>", "<li>{}</li>", "<div>{}</div>", "<tr><td>{}</td></tr>"])
            lines = "".join(line.format(self.words(1, 7)) for _ in range(r.choice([8, 20, 50, 120])))
            body = [*body[:1], {"<l": f"<ul>{lines}</ul>", "<t": f"<table>{lines}</table>"}.get(line[:2], lines)]
        elif r.random() < 0.35:  # prose and little else
            body = [*body[:1], *(r.choice(["<p>{}</p>"] * 5 + ["<p><b>{}<br>", "<p><em>{}</em></p>", "<p><span>{}</span><br></p>"]).format(self.words(*r.choice([(4, 20), (10, 40), (20, 70)]))) for _ in range(r.choice([4, 8, 15, 30])))]
            for _ in range(r.choice([0, 0, 1, 2])):
                body.insert(r.randint(1, len(body)), r.choice([self.block(), self.furniture(' data-y="0"')]))
        inner, bare = "".join(body), ""
        kind = r.randrange(18) if only is None else only
        if kind < 3:
            main = f'<article data-y="1">{inner}</article>'
        elif kind == 3:
            main = f'<main><article data-y="1">{inner}</article></main>'
        elif kind < 8:
            name = self.name("content main article post entry story text body page-content post-content entry-content main-content article-body article-content story-body")
            box = r.choice(["div", "div", "section"])
            main = f'<{box} {name} data-y="1">{inner}</{box}>'
        elif kind == 8:
            main = f'<main data-y="1">{inner}</main>'
        elif kind < 11:
            main = f'<div id="{r.choice(["main", "page", "wrapper"])}"><div class="{r.choice(["post entry", "article", "story-body", "entry-content"])}" data-y="1">{inner}</div>{self.furniture()}</div>'
        elif kind == 11:
            main = f'<div class="{r.choice(["wrapper", "container", "page", "row", "col"])}"><article class="post" data-y="1"><div class="text">{inner}</div></article>{self.furniture()}</div>'
        elif kind == 12:
            main = f'<div {self.plain()} data-y="1">{inner}</div>'
        elif kind == 13:
            main = f'<table><tr><td {self.plain()}>{self.furniture()}</td><td data-y="1">{inner}</td></tr></table>'
        elif kind == 14:  # a piece of markup
            return inner
        elif kind == 15:  # text that stands in the body itself
            main, bare = "<br><br>".join(self.words(5, 80) for _ in range(r.randint(1, 4))), ' data-y="1"'
        else:
            main, bare = inner, ' data-y="1"'
        out = ' data-y="0"' if bare else ""
        if r.random() < 0.3:
            main = f"<div {self.plain()}{bare}>{main}</div>" if not bare else main
        before, after = ("".join(self.furniture(out) for _ in range(r.choice([0, 1, 1, 2, 3]))) for _ in "ab")
        head = f'<head{out}><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{}}</style><script>track({r.random()});</script></head>'
        return f'<!DOCTYPE html><html data-y="0">{head}<body{bare}>{before}{main}{after}</body></html>'


def labelled_pages(n: int = 1000, seed: int = 11) -> list[str]:
    """Labelled training pages: furniture of common kinds around and in main texts of common kinds."""
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]


@cache
def default_model() -> Model:
    """The model of the labelled pages; fitted once for each driver."""
    return fit(labelled_pages())


SCHEMA = "page_id long, url string, text string, n_chars long"


def _run(model: Model):
    def made(batches):
        for b in pieces(batches, "html", 2.0):
            texts = extract_all(b.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return made


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each page: page_id, url, text (empty if none), n_chars (its code points)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(trimmed(_run(model or default_model())), SCHEMA)
