"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

A tolerant scanner cuts a page into leaf blocks (text between block-level tags) with their ancestors. Features
are ancestor tags, class and id words, and what the text looks like. Two labels, main text and the rest, are
scored with weights trained by maximum likelihood on labelled pages, and decoded by Viterbi. The labelled
pages are drawn by ``labelled_pages``: layouts of many kinds whose blocks have known labels. Training is bounded
by TRAIN_PAGES, takes a few seconds on the driver, and is the same in every run."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_PAGES = 400
TRAIN_SEED = 7
TRAIN_STEPS = 250

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup up to their end tag, or the page's end.
RAW = frozenset("script style iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "head", "label", "optgroup", "option", "select", "button"}
#: Drawings and formulas: their tags may close themselves, and a start tag of text ends an unclosed one, unless it
#: is in an element of the second kind.
FOREIGN, HOLDS_TEXT = ("svg", "math"), frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = (CLOSES_P - {"select"}) | frozenset("b big br code em embed i img p s small span strike strong sub sup tt u var".split())
#: A start tag that ends an open element of the same kind, unless one of the second kind is opened in between.
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}

#: A comment, markup of the kinds that end at the first >, or a tag with its attributes. Each goes to the page's end where
#: it is left open, so no place is looked at twice; a quote opens a value only after =, and only where it is closed.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|\Z|[^a-zA-Z>][^>]*(?:>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
class Place:
    """Where a block stands: its element, what it and those around it are called, the same below the innermost article or
    main (None: outside), and its depth. Sets are shared with the element around, and equal elements of one parent are
    one place, so that deep and long pages stay small."""

    __slots__ = ("tag", "names", "under", "depth", "kids")

    def __init__(self, tag: str, names: frozenset[str], under: frozenset[str] | None, depth: int):
        self.tag, self.names, self.under, self.depth = tag, names, under, depth
        self.kids: dict[tuple[str, tuple[str, ...]], Place] = {}

    def inner(self, tag: str, words: tuple[str, ...]) -> Place:
        kid = self.kids.get((tag, words))
        if kid is None:
            kid = self.kids[tag, words] = self._inner(tag, words)
        return kid

    def _inner(self, tag: str, words: tuple[str, ...]) -> Place:
        own = {f"in:{tag}", *(f"name:{w}" for w in words)}
        names = self.names if own <= self.names else self.names | own
        if tag in ("article", "main"):
            return Place(tag, names, NOTHING, self.depth + 1)
        below = {f"under:{tag}", *(f"under:{w}" for w in words)}
        under = self.under if self.under is None or below <= self.under else self.under | below
        return Place(tag, names, under, self.depth + 1)


NOTHING: frozenset[str] = frozenset()


def closes_itself(attrs: str) -> bool:
    """Whether the slash at the end is the tag's, not a bare value's."""
    return attrs.endswith("/") and (attrs[-2:-1] in "\"'" or "=" not in attrs[attrs.rfind(" ") + 1:])


def blocks(page: str | None) -> list[tuple[str, Place, float]]:
    """The leaf blocks in page order: (text, place, share of it in links). Work grows with the page, however its tags
    are left open."""
    out: list[tuple[str, Place, float]] = []
    if not page:
        return out
    stack = [Place("", NOTHING, None, 0)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    at = stack[0]
    linked = 0
    shut = True  # whether a template's end tag may follow

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, at, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal at, linked
        text = entities.unescape(raw) if "&" in raw else raw
        if not parts:
            if not text.strip():
                return
            at = stack[-1]
        parts.append(text)
        if opened["a"]:
            linked += len(text)

    def close(tag: str, barrier=()) -> None:
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                opened.subtract(p.tag for p in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in barrier:
                return

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            add(page[pos:].removesuffix("<"))  # the opening of a tag, of a page cut short
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        foreign = any(opened[f] for f in FOREIGN)
        if foreign and page.startswith("<![CDATA[", m.start()):
            end = page.find("]]>", m.start() + 9)
            add(entities.escape(page[m.start() + 9:end if end >= 0 else n]))
            pos = end + 3 if end >= 0 else n
        if not m[2] or not m[4]:  # no tag, or one that never ends
            continue
        tag, ending, attrs = m[2].lower(), m[1], m[3]
        if ending:
            if tag in BLOCK:
                flush()
            if tag == "br":
                parts and parts.append(" ")
            else:
                close(tag)
            continue
        closed = foreign and closes_itself(attrs)
        if tag in RAW:
            if not closed:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        if tag == "template" and shut:  # never shown; an unclosed one is like any other element
            end = re.compile(r"</template(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
            if end:
                pos = end.end()
                continue
            shut = False
        if tag in ENDS_FOREIGN:
            for f in FOREIGN:
                close(f, HOLDS_TEXT)
        if tag in CLOSES_P:
            close("select", BLOCK - {"select", "option", "optgroup"})
        if tag in BLOCK:
            flush()
        if tag == "br":
            parts and parts.append(" ")
        if tag in VOID or closed or tag in FOREIGN and closes_itself(attrs):
            continue
        if tag in CLOSES_P:
            close("p", BLOCK - {"p"})
        if tag in SAME:
            close(tag, SAME[tag])
        words: list[str] = []
        if attrs and "=" in attrs:
            for a in NAMES.findall(attrs):
                words += [w.lower() for w in PARTS.findall(a[0] or a[1] or a[2])]
        stack.append(stack[-1].inner(tag, tuple(words)))
        opened[tag] += 1
    flush()
    return out


#: What blocks around the main text say, and what one of must be in a text for the pattern to be tried at all.
HINTS = {
    "legal": (("©", "(c)", "copyright", "rights", "privacy", "terms of"), re.compile(r"©|\(c\)|copyright|all rights reserved|privacy|terms of (?:use|service)", re.I)),
    "notice": (("cookie", "consent", "subscribe", "newsletter", "sign", "log"), re.compile(r"cookie|consent|subscribe|newsletter|sign ?(?:in|up)|log ?in", re.I)),
    "advert": (("sponsored", "advert", "promo", "buy now", "sale"), re.compile(r"sponsored|advert|promo|buy now|sale", re.I)),
    "reply": (("reply", "share", "like", "comment", "ago"), re.compile(r"^(?:reply|share|like)|comments?$|\bago$", re.I)),
}


def path_features(at: Place) -> list[str]:
    f = {*at.names, "depth:" + str(min(6, at.depth)), "outside" if at.under is None else "inside", *(at.under or ())}
    if at.tag:
        f.add(f"leaf:{at.tag}")
    return sorted(f)


def text_features(text: str, linked: float) -> list[str]:
    n = len(text)
    f = ["any", "size:" + ("1" if n < 20 else "2" if n < 60 else "3" if n < 200 else "4"),
         "links:" + ("0" if linked == 0 else "1" if linked < 0.5 else "2")]
    if text[-1] in ".!?…":
        f.append("ended")
    low = text.lower()
    f += [k for k, (some, p) in HINTS.items() if any(map(low.__contains__, some)) and p.search(text)]
    return f


# ---- labelled pages -------------------------------------------------------------------------------------------

#: Class and id words that the labelled layouts use for each kind of block around the main text.
AROUND = {
    "menu": ["nav", "menu", "navbar", "breadcrumb", "toc", "links", "navigation", "topbar"],
    "header": ["header", "masthead", "banner", "branding", "logo", "top"],
    "footer": ["footer", "copyright", "bottom", "colophon", "legal", "footnotes"],
    "sidebar": ["sidebar", "aside", "widget", "related", "rail", "recommended", "popular", "trending"],
    "notice": ["notice", "cookie", "consent", "alert", "popup", "modal", "gdpr", "banner", "newsletter", "subscribe"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion"],
    "comments": ["comments", "comment", "respond", "discussion", "replies", "reader", "disqus"],
    "form": ["form", "search", "login", "signup", "contact"],
    "share": ["share", "social", "sharing", "tags", "byline", "meta"],
}
MAIN = ["content", "article", "post", "entry", "main", "story", "body", "text", "page"]

WORDS = "ab cdo efi gha ijke lmno pqre stu vwxa yzé elan oriv sunte marlo dekin fabru hostel quibe tarn vilto".split()


def labelled_pages(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> list[tuple[str, list[str]]]:
    """n pages with the texts of their main blocks."""
    r, more = random.Random(seed), random.Random(f"{seed} embedded")
    letters = "abcdefghijklmnopqrstuvwxyzéèäößñ"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    said = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a, b: said(a, b).capitalize() + r.choice(["."] * 6 + ["!", "?", ""])

    def named(kind: str, tags: list[str], inner: str) -> str:
        t = r.choice(tags)
        bare = t not in ("div", "section", "ul", "ol", "p") and r.random() < 0.6
        attr = "" if bare else f' {r.choice(["class", "class", "id"])}="{"-".join(r.sample(AROUND[kind], r.choice([1, 1, 2])))}"'
        return f"<{t}{attr}>{inner}</{t}>"

    def menu() -> str:
        return named("menu", ["nav", "nav", "div", "ul"], "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(3, 9))) + "</ul>")

    def boiler(kind: str) -> str:
        if kind == "menu":
            return menu()
        if kind == "footer":
            return named(kind, ["footer", "footer", "div"], r.choice([f"&copy; {word()} &middot; {sentence(3, 9)}", f"<p>Copyright {said(1, 4)}</p>", f"<p>{sentence(4, 30)}</p>"]))
        if kind == "header":
            return named(kind, ["header", "div"], r.choice([f"<a href='/'>{word()}</a><p>{sentence(2, 6)}</p>", f"<h2>{said(1, 3)}</h2>", f"<h1>{said(1, 2)}</h1>"]))
        if kind == "comments":
            return named(kind, ["div", "section", "ol"], "<h3>Comments</h3>" + "".join(f"<div class='comment'><b>{word()}</b><p>{sentence(3, 40)}</p></div>" for _ in range(r.randint(1, 4))))
        if kind == "form":
            return f"<form action='/x'><label>{said(1, 3)}</label><input name=q><p>{sentence(3, 10)}</p><button>{word()}</button></form>"
        if kind == "sidebar":
            return named(kind, ["aside", "aside", "div"], f"<h3>{said(1, 3)}</h3>" + r.choice([f"<p>{sentence(5, 50)}</p>", "<ul>" + "".join(f"<li><a href=x>{said(2, 6)}</a></li>" for _ in range(4)) + "</ul>"]))
        return named(kind, ["div", "section", "p"] if kind != "notice" else ["div", "dialog", "section"], r.choice([sentence(4, 60), f"<p>{sentence(4, 40)}</p>" if kind != "advert" else sentence(2, 30)]))

    def embedded(keep) -> str:
        """Content that other elements than those of plain text hold: all main text but the choices of a select, and
        comments below the text as the contrast."""
        some = lambda: " ".join(more.choice(WORDS) for _ in range(more.randint(3, 25))).capitalize() + more.choice([".", ".", ""])
        t = more.choice(["object", "canvas", "noscript", "math", "svg", "select", "select", "comments", "comments"])
        if t == "select":
            return "<select name=s>" + "".join(f"<option>{' '.join(more.sample(WORDS, more.randint(1, 3)))}</option>" for _ in range(more.randint(2, 5))) + "</select>"
        if t == "comments":
            return f"<div class='comments'><p>{some()}</p></div>"
        if t in FOREIGN:
            inner = keep(some())
            return f"<p><math><mtext>{inner}</mtext></math></p>" if t == "math" else f"<figure><svg><path d='M0 0'/><text>{inner}</text></svg></figure>"
        return f"<{t}>" + "".join(f"<p>{keep(some())}</p>" for _ in range(more.randint(1, 3))) + f"</{t}>"

    out = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(" ".join(text.split()))
            return text

        body = []
        if r.random() < 0.85:
            body.append(f"<h1>{keep(said(2, 9))}</h1>")
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.62:
                body.append(f"<p>{keep(sentence(1, 90))}" + r.choice(["</p>"] * 5 + [""]))
            elif x < 0.7:
                body.append(f"<p><b>{keep(sentence(1, 30))}<br>")
            elif x < 0.78:
                body.append(f"<h{r.randint(2, 4)}>{keep(said(1, 6))}</h2>".replace("</h2>", "") + "</h2></h3></h4>")
            elif x < 0.84:
                body.append("<ul>" + "".join(f"<li>{keep(sentence(2, 14))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.88:
                body.append(f"<blockquote><p>{keep(sentence(4, 30))}</p></blockquote>")
            elif x < 0.91:
                body.append(f"<pre>{keep(said(3, 12))}</pre>")
            elif x < 0.92:
                body.append(f"<table><tr><td>{keep(said(1, 4))}</td><td>{keep(said(1, 4))}</td></tr></table>")
            else:
                body.append(boiler(r.choice(["advert", "share", "sidebar", "form", "notice"])))
        for _ in range(more.choice([0, 0, 1, 2])):
            body.insert(more.randint(1, len(body)), embedded(keep))
        inner = "".join(body)
        x = r.random()
        if x < 0.5:
            inner = f"<article>{inner}</article>"
        elif x < 0.65:
            inner = f"<main><article class='{r.choice(MAIN)}'>{inner}</article></main>"
        elif x < 0.8:
            inner = f"<main>{inner}</main>"
        else:
            inner = f"<div {r.choice(['class', 'id'])}='{r.choice(MAIN)}-{r.choice(MAIN)}'>{inner}</div>"
        before = [boiler(k) for k in r.sample(["menu", "header", "notice", "advert", "form"], r.randint(0, 4))]
        after = [boiler(k) for k in r.sample(["footer", "comments", "sidebar", "advert", "notice", "form", "share", "menu"], r.randint(0, 5))]
        out.append((f"<html><head><title>{said(2, 5)}</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>", main))
    return out


# ---- the random field -----------------------------------------------------------------------------------------

Model = dict[str, float]


def likelihood(x: np.ndarray, y: np.ndarray, on: np.ndarray, w: np.ndarray, tr: np.ndarray, l2: float):
    """(mean log-likelihood less the penalty, its gradient by w, and by tr): x pages by blocks by features, y their labels,
    ``on`` where a page has a block. Sums over all labellings come from forward and backward passes."""
    n, long = on.shape
    both = on[:, 1:] & on[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    lse = lambda a, axis: np.log(np.exp(a - (top := a.max(axis=axis, keepdims=True))).sum(axis=axis)) + top.squeeze(axis)
    score = np.zeros((n, long, 2))
    score[:, :, 1] = x @ w
    fwd, bwd = np.zeros((n, long, 2)), np.zeros((n, long, 2))
    fwd[:, 0] = score[:, 0]
    for t in range(1, long):
        go = lse(fwd[:, t - 1, :, None] + tr, 1) + score[:, t]
        fwd[:, t] = np.where(on[:, t, None], go, fwd[:, t - 1])
    for t in range(long - 2, -1, -1):
        go = lse(tr + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where(on[:, t + 1, None], go, 0)
    z = lse(fwd[:, -1], 1)
    p = np.exp(fwd + bwd - z[:, None, None])[:, :, 1] * on
    pair = np.exp(fwd[:, :-1, :, None] + tr + (score + bwd)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
    value = (np.sum(score[:, :, 1] * (y * on)) + np.sum(seen * tr) - z.sum()) / n - l2 / 2 * (np.sum(w * w) + np.sum(tr * tr))
    return value, np.einsum("ntf,nt->f", x, y * on - p) / n - l2 * w, (seen - pair.sum((0, 1))) / n - l2 * tr


def train(pages=None, steps: int = TRAIN_STEPS, l2: float = 0.004) -> Model:
    """feature -> weight for the label 'main' against 'rest', and the transition weights 'next:ab'. Gradients of
    the likelihood come from forward and backward sums over all pages at once."""
    pages = labelled_pages() if pages is None else pages
    seqs, labels = [], []
    for page, main in pages:
        left = list(main)
        fs, ys = [], []
        for text, path, linked in blocks(page):
            y = text in left
            if y:
                left.remove(text)
            fs.append(path_features(path) + text_features(text, linked))
            ys.append(int(y))
        if fs:
            seqs.append(fs)
            labels.append(ys)
    names = sorted({f for s in seqs for b in s for f in b})
    at = {f: i for i, f in enumerate(names)}
    n, long = len(seqs), max(map(len, seqs))
    x = np.zeros((n, long, len(names)))
    y, on = np.zeros((n, long), int), np.zeros((n, long), bool)
    for i, (s, ys) in enumerate(zip(seqs, labels)):
        for t, b in enumerate(s):
            x[i, t, [at[f] for f in b]] = 1
        y[i, : len(s)], on[i, : len(s)] = ys, True
    w, tr = np.zeros(len(names)), np.zeros((2, 2))
    m1, v1 = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for step in range(1, steps + 1):
        _, gw, gt = likelihood(x, y, on, w, tr, l2)
        g = np.concatenate([gw, gt.ravel()])
        m1, v1 = 0.9 * m1 + 0.1 * g, 0.999 * v1 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
        w, tr = w + move[:-4], tr + move[-4:].reshape(2, 2)
    model = {f: float(w[i]) for f, i in at.items()}
    return model | {f"next:{a}{b}": float(tr[a, b]) for a in (0, 1) for b in (0, 1)}


_model: Model | None = None


def default_model() -> Model:
    global _model
    if _model is None:
        _model = train()
    return _model


def decode(found: list, model: Model, kept: dict | None = None) -> list[bool]:
    """Viterbi: the best labels of a page's blocks."""
    if not found:
        return []
    tr = [[model["next:00"], model["next:01"]], [model["next:10"], model["next:11"]]]
    kept = {} if kept is None else kept
    here: dict[Place, float] = {}  # by identity, of this page
    back: list[tuple[int, int]] = []
    a = b = 0.0
    for k, (text, path, linked) in enumerate(found):
        s = here.get(path)
        if s is None:
            key = path.tag, path.names, path.under, min(6, path.depth)  # equal features, whatever the depth below
            s = kept.get(key)
            if s is None:
                if len(kept) > 20_000:
                    kept.clear()
                s = kept[key] = sum(model.get(f, 0.0) for f in path_features(path))
            here[path] = s
        s += sum([model.get(f, 0.0) for f in text_features(text, linked)])
        if k:
            a0, a1, b0, b1 = a + tr[0][0], b + tr[1][0], a + tr[0][1], b + tr[1][1]
            back.append((int(a1 > a0), int(b1 > b0)))
            a, b = max(a0, a1), max(b0, b1) + s
        else:
            b = s
    now = int(b > a)
    out = [now]
    for p in reversed(back):
        now = p[now]
        out.append(now)
    return [bool(v) for v in reversed(out)]


def main_text(page: str | None, model: Model, kept: dict | None = None) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, y in zip(found, decode(found, model, kept)) if y)


def extract(df: DataFrame, model: Model | None = None, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) plus ``out_col``, the page's main text: blocks joined by one line feed.

    Null and empty pages have an empty text. Pages of any length, cut short or with unclosed tags are read as
    far as they go. Repeated rows give equal texts; an empty table gives an empty one; a clashing out_col is
    refused."""
    keep = df.columns if keep is None else keep
    if out_col.lower() in {c.lower() for c in keep}:
        raise ValueError(f"column {out_col} exists already; pass another out_col")
    model = default_model() if model is None else model
    fields = [df.schema[c] for c in keep]

    def run(batches):
        paths: dict = {}
        for b in batches:
            texts = [main_text(p, model, paths) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], [*keep, out_col])

    src = df.select(F.col(html_col).alias("__html"), *[F.col(k) for k in keep])
    return src.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.StringType())]))
