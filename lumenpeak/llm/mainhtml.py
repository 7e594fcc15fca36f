"""Main text of HTML pages by a tree-structured graphical model.

Every element of a page is a node with two states, content or not; the way from the
root to the article counts as content.  A node's own potential is a sum of weights of
its features (tag, words of class, id and role, amount of text and links below it);
a parent and a child share a potential over their two states.  One pass of messages
up the tree and one down give exact marginals, and the same passes give the gradient
when the weights are fitted to labelled pages.

Labelled pages are the short ones below, whose markup says what is content, and a
bounded sample of the given pages, labelled by their own <article> or <main>.
"""

from __future__ import annotations

import html
import math
import re
import sys
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

# Pages of the table that are used to fit, in the order of a hash of their ids, and
# the longest page among them.
SAMPLE_PAGES, SAMPLE_CHARS, EPOCHS, RATE, RIDGE = 60, 50_000, 15, 0.3, 0.001
SCHEMA = "page_id {kind}, url string, text string, n_chars bigint, blocks int"

# Fixed values of HTML: elements without content, elements whose content is no text of
# the page, block elements, and what an element closes when it opens.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp".split())
DROPPED = set("head script style noscript template title textarea select option button input svg iframe object "
              "canvas audio video map datalist".split())
# What may stand in a head; any other start tag, or text, ends a head that is still open.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
            "summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}),
          "option": ({"option"}, {"select"})}
# A comment, a declaration, or the beginning of a tag; attributes of a tag with the quoted ones whole.
MARK = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Elements in page order, and runs of text between block borders.

    ``segments`` has (node, text) pairs and None where a block begins or ends.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["#root"], [""]
        self.own, self.linked = [0], [0]
        self.segments: list[tuple[int, str] | None] = []
        self._read(source)

    def _open(self, parent: int, tag: str, attrs: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.own.append(0)
        self.linked.append(0)
        return len(self.tag) - 1

    def _marks(self, source: str) -> Iterator[tuple[int, int, str | None, str, bool]]:
        """(start, end, name or None, attributes, is an end tag) of each piece of markup.

        What is left without its ``>`` is text.  Where a quote of an attribute is never
        closed, tags end at the next ``>`` from there on, so nothing is read twice.  The
        content of RAW elements is passed over.
        """
        at, quotes = 0, True
        while m := MARK.search(source, at):
            start, name, attrs = m.start(), m[2], ""
            if m[0] == "<!--":
                end = source.find("-->", m.end())
                end = len(source) if end < 0 else end + 3
            elif name is None:
                end = source.find(">", m.end()) + 1
            else:
                stop = ATTRS.match(source, m.end()).end() if quotes else len(source)
                if stop == len(source) or source[stop] != ">":
                    quotes, stop = False, source.find(">", m.end())
                end, attrs = stop + 1, source[m.end():max(stop, m.end())]
            if end <= 0:
                return  # no more > in the page
            name = name and name.lower()
            yield start, end, name, attrs, bool(m[1])
            at = end
            if name in RAW and not m[1] and not attrs.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                stop = source.find(">", close.end()) if close else -1
                at = stop + 1 or len(source)
                yield at, at, None, "", False

    def _read(self, source: str) -> None:
        """``places`` has the places in the stack of each open name, ``blocks`` those of
        open blocks, so no step walks the stack but to close what it closes."""
        stack, places, blocks, links, dropped, at = [0], {}, [], 0, 0, 0
        segments, tags = self.segments, self.tag

        def last(name: str) -> int:
            return places[name][-1] if places.get(name) else 0

        def close(k: int) -> bool:
            """Close the stack from place k on; whether a block is closed."""
            nonlocal links, dropped
            for n in reversed(stack[k:]):
                name = tags[n]
                places[name].pop()
                links -= name == "a"
                dropped -= name in DROPPED
            del stack[k:]
            some = bool(blocks) and blocks[-1] >= k
            while blocks and blocks[-1] >= k:
                blocks.pop()
            return some

        def read(text: str) -> None:
            if dropped and tags[stack[-1]] == "head" and text and not text.isspace():
                close(len(stack) - 1)
            if text and not dropped and not text.isspace():
                node = stack[-1]
                segments.append((node, html.unescape(text) if "&" in text else text))
                self.own[node] += len(text)
                if links:
                    self.linked[node] += len(text)
            elif text and not dropped:
                segments.append((stack[-1], " "))

        for start, end, name, attrs, ends in self._marks(source):
            if start > at and not (name is None and start == end):
                read(source[at:start])
            at = end
            if name is None:
                continue
            if ends:  # an end tag without its start tag is passed over
                k = last(name)
                # an inline end tag does not close a block
                if k and (name in BLOCK or not blocks or blocks[-1] < k) and close(k):
                    segments.append(None)
                continue
            if dropped and (name in ("head", "body") or tags[stack[-1]] == "head" and name not in IN_HEAD):
                k = places["head"][0] if places.get("head") else 0
                if k and name == "head":
                    continue  # a second head inside the first
                if k:
                    close(k)
            if name == "br" and not dropped:
                segments.append((stack[-1], " "))
            if name in CLOSES:
                shut, bound = CLOSES[name]
                if name in BLOCK:
                    shut = shut | {"p"}
                low = max(map(last, bound))
                above = [places[x][k] for x in shut if places.get(x) and (k := bisect(places[x], low)) < len(places[x])]
                if above:
                    close(min(above))
            elif name in BLOCK and blocks and blocks[-1] > last("button") and tags[stack[blocks[-1]]] == "p":
                close(blocks[-1])
            if name in BLOCK:
                segments.append(None)
            if name in VOID or name in RAW and not attrs.endswith("/"):
                continue
            node = self._open(stack[-1], name, attrs)
            if attrs.endswith("/") and name in ("svg", "path", "iframe"):
                continue
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
            links += name == "a"
            dropped += name in DROPPED
        read(source[at:])

    def features(self) -> list[list[str]]:
        """Features of every node; text and links below it are summed upwards."""
        text, links = self.own[:], self.linked[:]
        for i in range(len(text) - 1, 0, -1):
            text[self.parent[i]] += text[i]
            links[self.parent[i]] += links[i]
        out = []
        for tag, attrs, n, linked in zip(self.tag, self.attrs, text, links):
            f = ["t:" + tag, f"n:{(n > 0) + (n > 40)}", f"l:{4 * linked // n if n else 4}"]
            if attrs:
                f += {"c:" + w.lower() for m in NAMES.finditer(attrs) for part in PART.findall(m[1] or m[2] or m[3] or "")
                      for w in CAMEL.split(part)}
                if HIDDEN.search(attrs):
                    f.append("hidden")
            out.append(f)
        return out


class Model:
    """Weights of features, and log potentials of (parent, child) states."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pair = [[1.0, -5.0], [0.0, 1.0]]

    def messages(self, parent: list[int], own: list[float]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of each node: from below with its own, from above, and in all."""
        exp, log = math.exp, math.log
        (p00, p01), (p10, p11) = [[exp(x) for x in row] for row in self.pair]
        up, sent = own[:], [0.0] * len(own)
        for i in range(len(own) - 1, 0, -1):
            e = exp(max(-30.0, min(30.0, up[i])))
            sent[i] = log((p11 * e + p10) / (p01 * e + p00))
            up[parent[i]] += sent[i]
        whole, above = up[:], [0.0] * len(own)
        for i in range(1, len(own)):
            above[i] = whole[parent[i]] - sent[i]
            e = exp(max(-30.0, min(30.0, above[i])))
            whole[i] += log((p11 * e + p01) / (p10 * e + p00))
        return up, above, whole

    def own(self, features: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in fs]) for fs in features]

    def learn(self, page: Page, labels: list[int], sums: dict, rate: float) -> None:
        """One step up the gradient of the page's conditional likelihood."""
        features = page.features()
        up, above, whole = self.messages(page.parent, self.own(features))
        grad: dict = {}
        for i, (fs, y) in enumerate(zip(features, labels)):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, whole[i]))))
            for f in fs:
                grad[f] = grad.get(f, 0.0) + y - p
            if i:
                joint = [[math.exp(self.pair[a][b] + a * max(-30, min(30, above[i])) + b * max(-30, min(30, up[i])))
                          for b in (0, 1)] for a in (0, 1)]
                total = sum(map(sum, joint))
                for a in (0, 1):
                    for b in (0, 1):
                        seen = labels[page.parent[i]] == a and y == b
                        grad[a, b] = grad.get((a, b), 0.0) + seen - joint[a][b] / total
        for k, g in grad.items():
            old = self.pair[k[0]][k[1]] if isinstance(k, tuple) else self.weights.get(k, 0.0)
            g -= RIDGE * old
            sums[k] = sums.get(k, 1e-6) + g * g
            new = old + rate * g / math.sqrt(sums[k])
            if isinstance(k, tuple):
                self.pair[k[0]][k[1]] = max(-6.0, min(6.0, new))
            else:
                self.weights[k] = new


# What a page's own elements mean when it is labelled by its markup.
ASIDE_TAGS = {"nav", "aside", "footer", "header", "form", *DROPPED}
ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "comment", "comments", "cookie", "cookies", "consent",
               "footer", "menu", "nav", "navigation", "navbar", "newsletter", "notice", "popup", "promo", "promoted",
               "related", "share", "sharing", "sidebar", "social", "sponsored", "sponsor", "subscribe", "breadcrumb",
               "breadcrumbs", "modal", "widget", "replies", "disqus", "toolbar", "copyright", "pagination"}


CONTENT_WORDS = ("content", "post", "entry", "story", "text", "article", "body", "page-content", "main", "prose")


def label(page: Page) -> list[int] | None:
    """1 for nodes of the article and those above it, by the page's own <article> or
    <main> (or role); None if it has none."""
    features = page.features()
    main = [t in ("article", "main") or "c:main" in f and t != "#root" for t, f in zip(page.tag, features)]
    if not any(main):
        return None
    inside, out = [False] * len(main), [0] * len(main)
    for i in range(1, len(main)):
        words = {f[2:] for f in features[i] if f[:2] == "c:"}
        off = page.tag[i] in ASIDE_TAGS or words & ASIDE_WORDS or "hidden" in features[i]
        inside[i] = (inside[page.parent[i]] or main[i]) and not off
        out[i] = int(inside[i])
    for i in range(len(main) - 1, 0, -1):
        if out[i]:
            out[page.parent[i]] = 1
    return out


def seeds() -> list[str]:
    """Small labelled pages: every word of ASIDE_WORDS and every tag beside an article,
    inside it and in pages that have a plain container instead; long and very short."""
    words = sorted(ASIDE_WORDS)
    link = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of the day</a></li></ul>"
    out = []
    for i, w in enumerate(words):
        v, u = words[(i + 7) % len(words)], words[(i + 19) % len(words)]
        tag = ("div", "section", "aside")[i % 3]
        for k, main in enumerate(("article", "main", "div role='main'", "div id='main'", "article class='post'",
                                  f"div class='{CONTENT_WORDS[i % len(CONTENT_WORDS)]}'",
                                  f"div class='{CONTENT_WORDS[(i + 3) % len(CONTENT_WORDS)]}'",
                                  f"section class='{CONTENT_WORDS[(i + 6) % len(CONTENT_WORDS)]}'")):
            size = (0, 1, 4, 12)[(i + k) % 4]
            other = (4, 0, 1, 12)[(i + 2 * k) % 4]
            text = "<p>" + "The article goes on with a whole sentence, and then another one. " * size + "Yes.</p>"
            noise = link if i % 2 else "<p>" + "Words that belong to the page, not to the text. " * other + "No.</p>"
            noise = ("<h3>Readers say</h3>", "", "<h4>More</h4>", "<h2>Also</h2>")[(i + k) % 4] + noise
            name = main.split()[0]
            full = (f"<h2>A part</h2>{text}<ul><li>A point that is made</li></ul><blockquote>{text}</blockquote>",
                    f"<section><h3>Part</h3><div>{text}{text}</div></section><ol><li><b>One</b> <i>point</i></li></ol>",
                    "<table><caption>T</caption><thead><tr><th>Name</th><th>Value</th></tr></thead><tbody><tr><td>a</td>"
                    "<td>12</td></tr></tbody></table><pre><code>x = 1</code></pre>" + text,
                    "<figure><figcaption>What it shows</figcaption></figure><dl><dt>Term</dt><dd>Its meaning</dd></dl>"
                    f"<div><div>{text}</div></div><p>With <a href='/c'>a link</a>, <em>stress</em>, <strong>more</strong>, "
                    "<span>and</span> <code>code</code>.</p><h4>Last</h4><hr>")[(i + k) % 4]
            inner = f"<{tag} class='{w}'>{noise}</{tag}>"
            article = f"<{main} data-main><h1>A title</h1>{text}{full + inner + text if size > 1 or k % 2 else ''}</{name}>"
            around = (f"<header><h1>Site</h1><nav>{link}</nav></header><{tag} id='{v}'>{noise}</{tag}>",
                      f"<div class='{u}'>{noise}</div><form><p>Your name</p></form><aside>{noise}</aside>"
                      "<footer><p>All rights reserved, and more.</p></footer>")
            body = f"{around[0]}{article}{around[1]}" if (i + k) % 5 else f"<div class='{w}'>{noise}</div>{article}"
            if (i + k) % 3 == 0:
                body = f"<div class='wrapper page container'>{body}</div>"
            out.append(f"<html><body>{body}</body></html>")
    out += [f"<html><body><div class='wrapper'><div class='header'>Site</div><div class='{c}' data-main>"
            f"{'<p>A sentence of the text that fills the page.</p>' * n}</div><div class='footer'>Bye</div></div></body></html>"
            for n, c in zip((1, 2, 3, 4) * 3, ("body content", "content", "text content", "article-content") * 3)]
    out += [f"<html><body><h1>A title</h1>{'<p>A sentence of the text that fills the page.</p>' * n}"
            f"<div class='{w}'><p>No.</p></div></body></html>" for n, w in enumerate(words[:20])]
    return out


def _seed_labels(page: Page) -> list[int]:
    """As ``label``, where a plain container or the body of the seeds counts as the article."""
    marks = [i for i, a in enumerate(page.attrs) if "data-main" in a] or [page.tag.index("body")]
    tag, page.tag[marks[0]] = page.tag[marks[0]], "main"
    found = label(page)
    page.tag[marks[0]] = tag
    return found


def fit(pages: list[str], epochs: int = EPOCHS) -> Model:
    labelled = [(p, _seed_labels(p)) for p in map(Page, seeds())]
    labelled += [(p, y) for p in map(Page, pages) if (y := label(p)) is not None]
    model, sums = Model(), {}
    for k in range(epochs):
        for i in range(len(labelled)):
            page, y = labelled[(i * 97 + k) % len(labelled)] if len(labelled) % 97 else labelled[i]
            model.learn(page, y, sums, RATE)
    return model


def extract(source: str | None, model: Model) -> list[str]:
    """Blocks of the article in page order."""
    if not source:
        return []
    page = Page(source)
    _, _, odds = model.messages(page.parent, model.own(page.features()))
    blocks, held = [], []
    for s in [*page.segments, None]:
        if s is None:
            if held:
                block = " ".join("".join(held).split())
                if block:
                    blocks.append(block)
                held = []
        elif odds[s[0]] >= 0:
            held.append(s[1])
    return blocks


def sample(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """The pages to fit on: their ids are picked first, so tasks send ids only."""
    fit_for = pages.where((F.length("html") <= SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)[ >]"))
    ids = written(fit_for.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most), "page-sample")
    rows = fit_for.join(F.broadcast(ids.where("page_id IS NOT NULL").distinct()), "page_id").select("page_id", "html")
    return [r.html for r in rows.orderBy("page_id", "html").limit(most).collect()]


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars, blocks of every row; NULL and empty pages, and pages
    without an article, have an empty text.  Repeated rows give equal results."""
    kind = dict(pages.dtypes)["page_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(h, model) for h in b.column("html").to_pylist()]
            texts = ["\n\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in found], pa.int32())],
                ["page_id", "url", "text", "n_chars", "blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(work, SCHEMA.format(kind=kind))
