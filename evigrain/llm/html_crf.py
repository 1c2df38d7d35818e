"""Main text of web pages with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts, each with its chain of
open tags. A block's features are its ancestor tags, classes and ids (by parts), its own tag, its text's length,
link share and signs, those of its neighbours, and how much text, links and sentences the elements around it
hold, and whether it lies in the one with the most prose. A two-label chain (boilerplate, main) scores the blocks together and
Viterbi decodes them.

The field is trained by gradient ascent on labelled pages that :func:`labelled_pages` generates: many
layouts of menus, headers, footers, sidebars, notices, adverts, forms and comments around an article, with
telling names, unknown ones or none on either, with marked-up text of no particular language. Scripts, styles and the like are never blocks.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import lean

BUCKETS = 1 << 12
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video head title textarea select option button".split())
RAW = frozenset("script style textarea title".split())
#: What may stand in a head; anything else ends it, where its end tag is left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mrow mi mn mo ms mtext mspace mstyle mpadded mphantom menclose mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split()
)
#: Elements of other languages inside a page: only these may close themselves with a slash.
FOREIGN = ("svg", "math")
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
_NAMED = re.compile(r"[^\s/>]+")
#: The rest of a tag: quotes count after an equals sign only; possessive, so that nothing is read twice.
_REST = re.compile(r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Numbers beyond every character, of any length; and noughts before one.
_FAR = re.compile(r"&#[1-9][0-9]{8,};?")
_NOUGHTS = re.compile(r"&#0+(?=[0-9])")
NAME_SIZE = 40


class Block:
    """A leaf block: its pieces of text, how many characters are links, and its features' summed weights."""

    __slots__ = ("around", "features", "inside", "links", "parts", "sums", "text")

    def __init__(self, features: tuple[int, ...], sums: tuple[float, float], inside: int):
        self.features, self.sums, self.inside, self.around = features, sums, inside, ()
        self.parts, self.links, self.text = [], 0, ""


class Path:
    """The open elements that aren't inline, with the features of all of them.

    A feature counts once, for the outermost element that has it; each element keeps the sum of weights up
    to it, so opening and closing cost its own features however deep it lies.
    """

    def __init__(self, weights: list[list[float]] | None):
        self.weights = weights
        self.seen: set[int] = set()
        self.open: list[tuple[str, tuple[int, ...], float, float]] = []
        #: The element around each element (by number, in page order), and the numbers of the open ones.
        self.outer: list[int] = []
        self.numbers: list[int] = []

    def push(self, name: str, parts: tuple[str, ...]) -> None:
        new = tuple(f for f in _element_features(name, parts) if f not in self.seen)
        self.seen.update(new)
        zero, one = self.open[-1][2:] if self.open else (0.0, 0.0)
        if self.weights:
            zero += sum(self.weights[f][0] for f in new)
            one += sum(self.weights[f][1] for f in new)
        self.open.append((name, new, zero, one))
        self.outer.append(self.numbers[-1] if self.numbers else -1)
        self.numbers.append(len(self.outer) - 1)

    def pop(self) -> None:
        self.seen.difference_update(self.open.pop()[1])
        self.numbers.pop()

    def block(self) -> Block:
        near, inside = [x[0] for x in self.open[-3:][::-1]], self.numbers[-1] if self.numbers else -1
        more = {_hash("bias"), _hash("leaf:" + (near[0] if near else "")), *(_hash(f"at{k}:{name}") for k, name in enumerate(near))} - self.seen
        if self.weights is None:  # the features themselves, to train on
            return Block((*sorted(self.seen), *sorted(more)), (0.0, 0.0), inside)
        zero, one = self.open[-1][2:] if self.open else (0.0, 0.0)
        return Block((), (zero + sum(self.weights[f][0] for f in more), one + sum(self.weights[f][1] for f in more)), inside)


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the end tag of the raw element ``name`` whose content begins at ``at`` stands; -1 without one.

    As in HTML, a script inside a comment inside a script takes the next end tag for itself.
    """
    if name != "script":
        m = _RAW_END[name].search(page, at)
        return m.start() if m else -1
    comment = inner = False
    for m in _SCRIPT.finditer(page, at):
        token = m[0].lower()
        if token == "<!--":
            comment = not page.startswith((">", "->"), m.end())
            inner = inner and comment
        elif token == "-->":
            comment = inner = False
        elif not m[1]:
            inner = comment
        elif inner:
            inner = False
        else:
            return m.start()
    return -1


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Each tag's start and end, name, whether it closes, and its attributes; comments have no name.

    Tags are read as HTML reads them: a quoted value may hold ``>``. A tag that ends nowhere takes the rest of
    the page, unless a quote that is never closed did it: then this and later tags end at the first ``>``.
    Content of raw elements is passed over. One pass: no character is read more than a few times.
    """
    at, size, quotes, foreign = 0, len(page), True, 0
    last = page.rfind(">") + 1
    while m := _START.search(page, at):
        start = m.start()
        if m[0] == "<!--":
            if short := next((x for x in (">", "->") if page.startswith(x, m.end())), None):
                at = m.end() + len(short)
            else:
                ends = page.find("-->", m.end())
                at = ends + 3 if ends >= 0 else size
            yield start, at, "", False, ""
            continue
        letter = page[m.end() - 1]
        if not letter.isalpha():  # declarations, and end tags without a name
            at = page.find(">", m.end()) + 1 if m.end() < last else size
            yield start, at, "", False, ""
            continue
        named = _NAMED.match(page, m.end() - 1)
        rest = None
        if named.end() < last:
            rest = _REST.match(page, named.end(), last) if quotes else None
            if rest is None:
                quotes = False
        if rest is None:
            at = page.find(">", named.end()) + 1 or size
            if at == size and page[-1:] != ">":
                yield start, size, "", False, ""
                return
        else:
            at = rest.end()
        name, closing = named[0].lower(), m[0][1] == "/"
        yield start, at, name, closing, page[named.end() : at - 1]
        if name in FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not _self_closed(page[named.end() : at - 1]))
        elif foreign and not closing and name in ("body", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "img", "span"):
            foreign = 0  # these end it
        if name in RAW and not closing and not foreign:
            at = _raw_end(page, name, at)
            if at < 0:  # it holds the rest of the page
                yield size, size, "", False, ""
                return


def _self_closed(rest: str) -> bool:
    """Whether a tag's attributes end in a slash of its own, not in one of an unquoted value."""
    if not rest.endswith("/"):
        return False
    last = rest.rsplit(None, 1)[-1]
    if last == "/":
        return not rest[:-1].rstrip().endswith("=")
    return "=" not in last or last[-2] in "\"'"


def _decoded(text: str) -> str:
    """Character references decoded (numbers beyond Unicode as U+FFFD), white space as one space, trimmed."""
    if "&#" in text:
        text = _FAR.sub("\ufffd", _NOUGHTS.sub("&#", text))
    return _SPACE.sub(" ", html.unescape(text)).strip()


def blocks(page: str, weights: list[list[float]] | None = None) -> list[Block]:
    """Leaf blocks of a page in order, without empty ones. Broken markup is read as far as it goes.

    Blocks carry their features or, given ``weights``, the features' summed weights. Time and memory grow
    with the page, however many tags it opens.
    """
    out: list[Block] = []
    open_: list[str] = []
    path = Path(weights)
    named: Counter[str] = Counter()
    silent = 0
    current: Block | None = None

    def text(s: str) -> None:
        nonlocal current
        if open_ and open_[-1] == "head" and s and not s.isspace():
            pop("head")
        if silent or not s:
            return
        if current is None:
            if s.isspace():
                return
            current = path.block()
            out.append(current)
        current.parts.append(s)
        if named["a"]:
            current.links += len(s)

    def pop(name: str) -> None:
        nonlocal silent
        while open_:
            top = open_.pop()
            named[top] -= 1
            silent -= top in SILENT
            if top not in INLINE:
                path.pop()
            if top == name:
                return

    at = 0
    for start, end, name, closing, rest in _tags(page):
        text(page[at:start])
        at = end
        if not name:
            continue
        if open_ and open_[-1] == "head" and name not in IN_HEAD and (not closing or name in ("body", "br")):
            pop("head")
        if name == "br":
            text("\n")
            continue
        if name not in INLINE and not silent:
            current = None
        if closing:
            if named[name] > 0:
                pop(name)
            continue
        if name in ENDS_P and "p" in open_[-6:]:
            pop("p")
        if name in ("li", "option", "tr", "td", "th", "dd", "dt") and open_ and open_[-1] == name:
            pop(name)
        if name == "body" and silent:
            while open_ and open_[-1] != "html":
                pop(open_[-1])
        if name in VOID or (_self_closed(rest) and (name in FOREIGN or any(named[x] for x in FOREIGN))):
            continue
        parts: tuple[str, ...] = ()
        if "=" in rest:
            parts = tuple(p[:NAME_SIZE] for x in _NAME.finditer(rest) for p in _PART.findall((x[2] or x[3] or x[4] or "").lower()))
        open_.append(name)
        named[name] += 1
        silent += name in SILENT
        if name not in INLINE:
            path.push(name, parts)
    text(page[at:])
    kept = []
    for b in out:
        b.text = _decoded("".join(b.parts))
        if b.text:
            kept.append(b)
    _weigh(kept, path.outer)
    return kept


CLIMB = 5


def _weigh(page: list[Block], outer: list[int]) -> None:
    """Gives each block what stands around it: text, links and sentences of the elements it lies in."""
    total = sum(len(b.text) for b in page)
    chars, linked, stops, prose = ([0] * len(outer) for _ in range(4))
    for b in page:
        if b.inside < 0:
            continue
        n = len(b.text)
        share = b.links / max(1, sum(map(len, b.parts)))
        chars[b.inside] += n
        linked[b.inside] += int(n * share)
        stops[b.inside] += sum(b.text.count(c) for c in ".!?")
        if n >= 25 and share < 0.3 and outer[b.inside] >= 0:
            prose[outer[b.inside]] += n
            if (o := outer[outer[b.inside]]) >= 0:
                prose[o] += n // 2
    for e in range(len(outer) - 1, -1, -1):
        if (o := outer[e]) >= 0:
            chars[o] += chars[e]
            linked[o] += linked[e]
            stops[o] += stops[e]
    best = max(range(len(prose)), key=prose.__getitem__, default=-1)
    known: dict[int, tuple[str, ...]] = {}
    for b in page:
        e = b.inside
        if e not in known:
            found, at = [f"whole:{bool(e >= 0 and stops[e] > 1)}"], e
            for k in (1, 2):
                at = outer[at] if at >= 0 else -1
                if at >= 0:
                    own = linked[at] / max(1, chars[at])
                    found += [f"mass{k}:{chars[at].bit_length()}", f"part{k}:{min(9, 10 * chars[at] // max(1, total))}", f"linked{k}:{0 if own < 0.1 else 1 if own < 0.5 else 2}", f"full{k}:{min(stops[at].bit_length(), 6)}"]
            at, near = e, False
            for _ in range(CLIMB):
                near = near or (at >= 0 and at == best)
                at = outer[at] if at >= 0 else -1
            known[e] = (*found, f"best:{near}", f"best:{near}:{min(prose[best].bit_length() if best >= 0 else 0, 11)}")
        b.around = known[e]


@lru_cache(maxsize=100_000)
def _hash(s: str) -> int:
    h = 2166136261
    for c in s[:NAME_SIZE].encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


def _element_features(name: str, parts: tuple[str, ...]) -> list[int]:
    return sorted({_hash("in:" + name), *(_hash("named:" + p) for p in parts), *(_hash("word:" + p[:4]) for p in parts)})


def _own_features(page: list[Block]) -> list[tuple[int, ...]]:
    """The features of each block's own text and place, of its neighbours' texts, and of what it lies in."""
    sizes = ["-", *(f"{min(len(b.text).bit_length(), 10)}" for b in page), "-"]
    links = ["-", *(f"{0 if x < 0.1 else 1 if x < 0.5 else 2}" for x in (b.links / max(1, sum(map(len, b.parts))) for b in page)), "-"]
    out = []
    for i, b in enumerate(page):
        near = "best:True" in b.around
        own = [
            *b.around,
            f"size:{sizes[i + 1]}",
            f"size:{sizes[i + 1]}:{links[i + 1]}:{near}",
            f"links:{links[i + 1]}",
            f"before:{sizes[i]}:{links[i]}:{near}",
            f"after:{sizes[i + 2]}:{links[i + 2]}:{near}",
            f"stops:{min(sum(b.text.count(c) for c in '.!?'), 3)}",
            f"ends:{b.text[-1] in '.!?'}",
            f"mark:{'©' in b.text}{'|' in b.text}{near}",
            f"first:{i == 0}",
            f"last:{i == len(page) - 1}",
        ]
        out.append(tuple(_hash(f) for f in own))
    return out


def _features(page: list[Block]) -> list[tuple[int, ...]]:
    """All features of blocks that were read without weights."""
    return [(*b.features, *own) for b, own in zip(page, _own_features(page), strict=True)]


def _either(x: float, y: float) -> float:
    """log(exp(x) + exp(y))."""
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


class Chain:
    """A two-label linear chain: weights of features by label, and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.w, self.t = weights, steps

    @cached_property
    def weights(self) -> list[list[float]]:
        return self.w.tolist()

    def emissions(self, page: list[tuple[int, ...]]) -> np.ndarray:
        flat = np.concatenate([np.asarray(x) for x in page])
        at = np.cumsum([0, *(len(x) for x in page[:-1])])
        return np.add.reduceat(self.w[flat], at, axis=0)

    def decode(self, page: list[tuple[int, ...]], sums: list[tuple[float, float]] | None = None) -> list[int]:
        """The best labelling (Viterbi), ties to boilerplate; ``sums`` are added to the features' weights."""
        e, t = self.emissions(page).tolist(), self.t.tolist()
        if sums:
            e = [[a + x, b + y] for (a, b), (x, y) in zip(e, sums, strict=True)]
        score, back = e[0], []
        for row in e[1:]:
            from0 = [score[0] + t[0][0], score[1] + t[1][0]]
            from1 = [score[0] + t[0][1], score[1] + t[1][1]]
            b = (int(from0[1] > from0[0]), int(from1[1] > from1[0]))
            back.append(b)
            score = [row[0] + from0[b[0]], row[1] + from1[b[1]]]
        label = int(score[1] > score[0])
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    @staticmethod
    def train(pages: list[tuple[list[tuple[int, ...]], list[int]]], epochs: int = 6, rate: float = 0.2, ridge: float = 1e-4, seed: int = 5) -> Chain:
        """Stochastic gradient ascent on the conditional likelihood, by forward and backward sums; the later half's mean weights."""
        rng = random.Random(seed)
        w, t = np.zeros((BUCKETS, 2)), np.zeros((2, 2))
        grown, grown_t = np.full((BUCKETS, 2), 1e-6), np.full((2, 2), 1e-6)
        net = Chain(w, t)
        order = list(range(len(pages)))
        late, late_t, steps = np.zeros_like(w), np.zeros_like(t), 0
        for epoch in range(epochs):
            rng.shuffle(order)
            for k in order:
                page, labels = pages[k]
                e = net.emissions(page)
                n = len(e)
                rows_, (s00, s01), (s10, s11) = e.tolist(), *t.tolist()
                ahead, back = [rows_[0]], [[0.0, 0.0]]
                for e0, e1 in rows_[1:]:
                    x0, x1 = ahead[-1]
                    ahead.append([e0 + _either(x0 + s00, x1 + s10), e1 + _either(x0 + s01, x1 + s11)])
                for e0, e1 in rows_[:0:-1]:
                    x0, x1 = back[-1][0] + e0, back[-1][1] + e1
                    back.append([_either(s00 + x0, s01 + x1), _either(s10 + x0, s11 + x1)])
                a, b = np.array(ahead), np.array(back[::-1])
                z = np.logaddexp(a[-1, 0], a[-1, 1])
                p = np.exp(a + b - z)
                y = np.eye(2)[labels]
                g = y - p
                pairs = np.zeros((2, 2))
                if n > 1:
                    q = np.exp(a[:-1, :, None] + t + (e[1:] + b[1:])[:, None, :] - z).sum(0)
                    np.add.at(pairs, (labels[:-1], labels[1:]), 1)
                    pairs -= q
                flat = np.concatenate([np.asarray(x) for x in page])
                rows = np.repeat(np.arange(n), [len(x) for x in page])
                grad = np.zeros((BUCKETS, 2))
                np.add.at(grad, flat, g[rows])
                used = np.unique(flat)
                gr = grad[used] - ridge * w[used]
                grown[used] += gr**2
                w[used] += rate * gr / np.sqrt(grown[used])
                grown_t += pairs**2
                t += rate * pairs / np.sqrt(grown_t)
                if epoch >= epochs // 2:
                    late += w
                    late_t += t
                    steps += 1
        return Chain(late / steps, late_t / steps) if steps else net


def labelled_pages(n: int = 1000, seed: int = 11) -> Iterator[tuple[str, list[bool]]]:
    """Generated pages, and for each of their leaf blocks whether it is main text.

    Main text is wrapped in a private mark that is taken out again to find the labels.
    """
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvéüñ"
    pool = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)]

    def words(lo: int, hi: int, stop: bool = True) -> str:
        s = " ".join(rng.choices(pool, k=rng.randint(lo, hi)))
        if rng.random() < 0.15:
            s = " ".join(x + rng.choice(["***", "%%%", "|", "&amp;&amp;", "!!"]) for x in s.split())
        return s.capitalize() + (rng.choice([".", ".", ".", "!", "?", "", ""]) if stop else "")

    def menu(tag: str, name: str) -> str:
        each = rng.choice(["<li>{}</li>", "<li>{}</li>", "{} ", "<div>{}</div>", "{} | ", "<td>{}</td>"])
        links = "".join(each.format(rng.choice([f'<a href="/{k}">', f"<a href=/{k}/>"]) + words(1, 2, False) + "</a>") for k in range(rng.randint(3, 8)))
        return f"<{tag}{name}>{'<ul>' + links + '</ul>' if '<li>' in each else links}</{tag}>"

    def unknown() -> str:
        """A class that tells nothing, or none."""
        x = rng.choice([f"{rng.choice('cxkbs')}{rng.randint(1, 99)}", "".join(rng.choice(letters[:18]) for _ in range(rng.randint(2, 8)))])
        return rng.choice(["", f' class="{x}"', f' class="{x}"', f" class={x}", f" class={x} data-u=/{x}/", f' id="{x}"'])

    def named(*names: str) -> str:
        x = rng.choice(names)
        return rng.choice([f' class="{x}"', f' id="{x}"', f" class={x}", f" class={x} data-u=/a/", f' class="{rng.choice('cxkbs')}{rng.randint(1, 9)} {x}"'])

    def seldom(*names: str) -> str:
        return unknown() if rng.random() < 0.35 else named(*names)

    def side(kind: str) -> str:
        few = lambda: "".join(f"<p>{words(3, 25)}</p>" for _ in range(rng.randint(1, 3)))
        if kind == "nav":
            return menu(*rng.choice([("nav", ""), ("nav", named("nav", "main-nav")), ("div", seldom("menu", "navbar", "breadcrumb", "nav", "topnav")), ("ul", seldom("menu", "nav"))]))
        if kind == "header":
            return rng.choice([f"<header><div>{words(1, 4, False)}</div>{menu('nav', '')}</header>", f"<div{seldom('header', 'masthead', 'banner', 'site-header', 'logo')}>{words(1, 6, False)}</div>", f"<header><h2>{words(1, 3, False)}</h2></header>"])
        if kind == "footer":
            end = f"{rng.choice(['&copy;', '©', ''])} {words(1, 3, False)} {rng.choice(['&middot;', '|', ''])} {words(2, 20)}"
            return rng.choice([f"<footer>{end}</footer>", f"<footer><p>{end}</p></footer>", f"<div{seldom('footer', 'site-footer', 'copyright', 'foot')}>{end}</div>", f"<p{unknown()}>{end}</p>"])
        if kind == "aside":
            return rng.choice([f"<aside>{few()}</aside>", f"<aside{named('sidebar', 'widget')}>{few()}</aside>", f"<div{named('sidebar', 'widget', 'related', 'recommended', 'side', 'rail', 'share', 'social', 'newsletter', 'tags')}><h3>{words(1, 4, False)}</h3>{few()}</div>"])
        if kind == "ad":
            return rng.choice([f"<!-- ad {rng.randint(0, 9)} --><div{named('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'promo', 'banner-ad', 'sponsored')}>{words(3, 25)}</div>", f"<ins{named('adsbygoogle', 'ad')}><div{named('ad', 'ads')}>{words(2, 9)}</div></ins>"])
        if kind == "notice":
            return f"<div{named('cookie', 'cookie-notice', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'overlay', 'disclaimer')}>{rng.choice(['<p>' + words(5, 30) + '</p>', words(5, 30)])}</div>"
        if kind == "form":
            return f"<form{rng.choice(['', named('search', 'subscribe', 'login', 'signup')])}><label>{words(1, 3, False)}</label><input type=text><p>{words(2, 12)}</p></form>"
        each = "".join(rng.choice([f'<div class="comment"><p>{words(3, 40)}</p></div>', f"<li><p>{words(3, 40)}</p></li>", f"<article{named('comment')}><p>{words(3, 30)}</p></article>"]) for _ in range(rng.randint(1, 4)))
        return rng.choice([f"<section{named('comments', 'comment-list', 'responses', 'discussion')}><h3>{words(1, 2, False)}</h3>{each}</section>", f"<div{named('comments', 'comments-area', 'disqus', 'replies')}>{each}</div>", f"<ol{named('comment-list', 'commentlist')}>{each}</ol>"])

    def mark(s: str) -> str:
        return f"\x01{s}\x02"

    def body(size: int) -> str:
        out = [f"<h1{unknown()}>{mark(words(2, 12))}</h1>"] if rng.random() < 0.5 else []
        usual = rng.choice(["<p>{}</p>"] * 4 + ["<div>{}</div>", "<div>{}</div>", "<p>{}", f"<p{unknown()}>{{}}</p>", f"<div{unknown()}>{{}}</div>", "<div><span>{}</span></div>", "{}<br><br>", "<tr><td>{}</td></tr>"])
        for _ in range(size):
            s = words(*rng.choice([(1, 4), (5, 40), (30, 160), (30, 160)]))
            if rng.random() < 0.2:
                s = f"<b>{mark(s)}" + rng.choice(["</b>", "", "<br>"])
            elif rng.random() < 0.15:
                s = mark(f"{s} <a href='/x'>{words(1, 3, False)}</a> {words(1, 9)}")
            else:
                s = mark(s)
            out.append(rng.choice([usual] * 12 + ["<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]).format(s))
            if rng.random() < 0.06:
                out.append(side(rng.choice(["ad", "aside", "form", "notice"])))
        return "".join(out)

    for _ in range(n):
        free = [f"<div{unknown()}>{{}}</div>" for _ in range(8)] + [f"<div{unknown()}><div{unknown()}>{{}}</div></div>" for _ in range(4)] + [f"<section{unknown()}>{{}}</section>", f"<table><tr><td{unknown()}>{{}}</td></tr></table>", f"<table><tr><td{unknown()}>{{}}</td></tr></table>", f"<div{named('text', 'story', 'txt', 'main', 'body', 'wrapper', 'wrapper', 'page', 'container')}>{{}}</div>", f"<div{named('text', 'story', 'txt', 'main')}>{{}}</div>"]
        wrap = rng.choice(free + ["<article>{}</article>"] * 6 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', '<article class="post"><section>{}</section></article>', '<div class="article-body">{}</div>', "{}", "<div>{}</div>"])
        before = [side(k) for k in ("notice", "header", "ad", "form", "aside", "nav") if rng.random() < (0.6 if k == "nav" else 0.3)]
        after = [side(k) for k in ("comments", "aside", "ad", "form", "notice", "nav", "footer") if rng.random() < 0.4]
        if rng.random() < 0.3:
            rng.shuffle(before)
        inner = body(rng.choice([0, 1, 3, 8, 15]))
        if rng.random() < 0.15:
            inner += side("comments")
        head = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        end = rng.choice(["</body></html>", "</body></html>", ""])
        within = "".join(before) + wrap.format(inner) + "".join(after)
        if rng.random() < 0.2:
            bare = lambda: rng.choice([" ".join(f"<a href=/{k}>{words(1, 2, False)}</a>" for k in range(4)), f"{rng.choice(['&copy; ', '© ', ''])}{rng.randint(1990, 2030)} {words(2, 20)}"])
            cells = [[x if rng.random() < 0.4 else bare() for x in side_] for side_ in (before, after)]
            within = "<table>" + "".join(f"<tr><td{unknown()}>{x}</td></tr>" for x in [*cells[0], wrap.format(inner), *cells[1]]) + "</table>"
        elif rng.random() < 0.3:
            within = f"<div{rng.choice([unknown(), named('page', 'wrapper', 'container', 'site')])}>{within}</div>"
        marked = head + within + end
        yield marked.replace("\x01", "").replace("\x02", ""), ["\x01" in "".join(b.parts) for b in blocks(marked)]


@lru_cache(maxsize=1)
def model() -> Chain:
    """The trained field: some seconds, once per driver process; the same weights every time.

    Half of the pages are learned a second time without names and tags, so that texts and what they lie in
    tell main text where nothing is named.
    """
    pages = []
    for k, (page, labels) in enumerate(labelled_pages()):
        found = blocks(page)
        if found and len(found) == len(labels):
            right = [int(x) for x in labels]
            pages.append((_features(found), right))
            if k % 2:
                pages.append((_own_features(found), right))
    return Chain.train(pages)


def main_text(page: str | None, chain: Chain) -> str:
    """The main blocks' texts in page order, joined by one space."""
    found = blocks(page or "", chain.weights)
    if not found:
        return ""
    labels = chain.decode(_own_features(found), [b.sums for b in found])
    return " ".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points), one row for each row.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
    joined in page order by one space. A null or empty page, and one without main text, has an empty text.
    Null ids and urls are passed on, repeated rows answered each; other columns are left out; no rows give no
    rows. Pages of any length and depth are read whole, in time and memory that grow with their length.
    Labels with equal scores go to boilerplate. Memory: one batch.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            texts = [main_text(x, chain) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(work), "page_id long, url string, text string, n_chars long")
