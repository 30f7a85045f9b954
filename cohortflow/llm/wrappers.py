"""Main text of web pages by union-free wrappers inferred per host.

A page is a stream of tags and texts. Runs of the same block are folded into one repeated group. A host's wrapper starts as
its first page's stream; each further page is aligned with it, and mismatches are resolved without unions: unequal texts
become a slot, tags that only one side has become optional, folded runs are repeated. Every task infers wrappers of the
hosts in its own pages; wrappers (not pages) are then merged by the same alignment, first by salted host, then by host, so a
host with a third of all pages costs no more than others. Pages meet their host's wrapper in a join that may be split.

A wrapper knows for each text its place (the open containers), whether it was ever unequal, and its length. The main region
is the article where the host has one; else the deepest container that holds most of the text in unequal slots. Menus,
headers, footers, asides, forms, notices, adverts, comments, scripts and styles inside or outside of it are no main text.
A page of another template, without text in its host's region, has the region of its own slots. A class word rules out a
container it names ("has-sidebar" names none), unless hardly any unequal text of the wrapper is left without the container.

A null or empty page, or one without main text, has the empty text. A page without a host in its url belongs to the host
``''``. Repeated rows are extracted each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame, functions as F

from cohortflow.session import written

from .textkit import arrow_batch

SALTS = 64
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# Names of what is no main text, as tags or as words of class, id and role.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select"}
ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies",
               "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related",
               "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
MODIFIERS = {"has", "have", "with", "without", "no", "not", "non", "hide", "hides", "show", "shows"}  # a class with one tells of another container
SPARED = 0.1  # share of unequal text outside of containers ruled out by class below which these are not ruled out
MAIN_WORDS = {"article", "articlebody", "main"}
DEEP = 60  # containers of one path; of deeper ones only the first aside and the first article are kept


def stream(page: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(key, text, path) of each token: tags have keys like ``<p`` and ``</p``, texts have the key ``#``."""
    out, stack, at, n = [], [], 0, len(page)
    deep: list[tuple[str, ...]] = []  # for each container beyond DEEP, what of it and those around it is kept
    while at <= n:
        m = TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not text.isspace():
            out.append(("#", text, (*stack[:DEEP], *(deep[-1] if deep else ()))))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            out.append((f"</{name}", "", ()))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].split(" ", 1)[0] == name:
                    del stack[i:]
                    del deep[max(i - DEEP, 0):]
                    break
            continue
        if name in RAW and name != "head":
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        words = sorted({w for a in ATTRIBUTE.findall(m[3]) for c in (a[1] or a[2] or a[3]).lower().split() for w in named(c)}) if m[3] else []
        label = " ".join([name, *words]) if name not in INLINE else name
        out.append((f"<{label}", "", ()))
        if name not in VOID and name not in INLINE and name != "p":
            stack.append(label)
            if len(stack) > DEEP:
                kept = deep[-1] if deep else ()
                new = (aside((label,)) and not aside(kept)) or (in_article((label,)) and not in_article(kept))
                deep.append((*kept, label) if new else kept)
    return out


def named(name: str) -> list[str]:
    """Words of a class, id or role; one that tells of another container stays whole."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    return words if MODIFIERS.isdisjoint(words) else [name]


def folded(keys: list[str], longest: int = 12) -> tuple[list[int], list[int], list[bool]]:
    """Runs of equal blocks become one: (positions kept, kept position's place for every position, whether repeated)."""
    keep, place, rep, i = [], [0] * len(keys), [], 0
    while i < len(keys):
        for p in range(1, longest + 1):
            k = 1
            while keys[i:i + p] == keys[i + k * p:i + (k + 1) * p] and i + (k + 1) * p <= len(keys):
                k += 1
            if k > 1:
                for j in range(k * p):
                    place[i + j] = len(keep) + j % p
                keep += range(i, i + p)
                rep += [True] * p
                i += k * p
                break
        else:
            place[i] = len(keep)
            keep.append(i)
            rep.append(False)
            i += 1
    return keep, place, rep


def of_page(tokens) -> tuple[list[list], list[int]]:
    """The page as a wrapper, and each token's node. Node: [key, optional, repeated, text hash or None where unequal, path, chars]."""
    keep, place, rep = folded([t[0] for t in tokens])
    nodes = [[tokens[i][0], False, r, "", list(tokens[i][2]), 0] for i, r in zip(keep, rep)]
    for (key, text, _), at in zip(tokens, place):
        if key == "#":
            node, text = nodes[at], " ".join(text.split())
            code = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
            node[3] = code if node[5] == 0 or node[3] == code else None
            node[5] += len(text)
    return nodes, place


def aligned(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Matching nodes of two wrappers, in order. Where they differ, the nearer way to meet again is taken."""
    spots: list[dict] = [{}, {}]
    for d, side in zip(spots, (a, b)):
        for i, node in enumerate(side):
            d.setdefault(node[0], []).append(i)

    def next_at(d, key, i):
        found = d.get(key, ())
        j = bisect_left(found, i)
        return found[j] if j < len(found) else None

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        y, x = next_at(spots[1], a[i][0], j), next_at(spots[0], b[j][0], i)
        if y is None and x is None:
            i, j = i + 1, j + 1
        elif x is None or (y is not None and y - j <= x - i):
            j = y
        else:
            i = x
    return out


def merged(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for both."""
    out, i, j = [], 0, 0
    for x, y in [*aligned(a, b), (len(a), len(b))]:
        out += [[n[0], True, *n[2:]] for n in (*a[i:x], *b[j:y])]
        if x < len(a) and y < len(b):
            p, q = a[x], b[y]
            out.append([p[0], p[1] or q[1], p[2] or q[2], p[3] if p[3] == q[3] else None, p[4], p[5] + q[5]])
        i, j = x + 1, y + 1
    return out


def aside(path, spared=frozenset()) -> bool:
    return any(w[0] in ASIDE_TAGS or (label not in spared and not ASIDE_WORDS.isdisjoint(w[1:])) for label, w in ((label, label.split(" ")) for label in path))


def in_article(path) -> bool:
    return any(w[0] in ("article", "main") or not MAIN_WORDS.isdisjoint(w[1:]) for w in (label.split(" ") for label in path))


def deepest(slots: list[list]) -> list[str]:
    """Path of the deepest container with most of the text in ``slots``."""
    total, path = sum(n[5] for n in slots), []
    while True:
        share: dict[str, int] = {}
        for n in slots:
            if len(n[4]) > len(path) and n[4][:len(path)] == path:
                share[n[4][len(path)]] = share.get(n[4][len(path)], 0) + n[5]
        best = max(share, key=lambda k: (share[k], k), default=None)
        if best is None or 2 * share[best] <= total:
            return path
        path = [*path, best]


def spared(wrapper: list[list]) -> frozenset:
    """Containers that hold most of the unequal text and are not ruled out by a class, as hardly any would be left."""
    texts = [n for n in wrapper if n[0] == "#" and not any(label.split(" ")[0] in ASIDE_TAGS for label in n[4])]
    slots = [n for n in texts if n[3] is None] or texts
    total = sum(n[5] for n in slots)
    if sum(n[5] for n in slots if not aside(n[4])) >= SPARED * total:
        return frozenset()
    return frozenset(deepest(slots))


def main_path(wrapper: list[list]) -> list[str] | None:
    """None if the wrapper has an article; else the path of the deepest container with most of the unequal text."""
    keep = spared(wrapper)
    texts = [n for n in wrapper if n[0] == "#" and not aside(n[4], keep)]
    if any(in_article(n[4]) for n in texts):
        return None
    return deepest([n for n in texts if n[3] is None] or texts)


def main_text(page: str, wrapper: list[list], region: list[str] | None, keep: frozenset | None = None) -> str:
    tokens, keep = stream(page), spared(wrapper) if keep is None else keep
    nodes, place = of_page(tokens)
    if [n[0] for n in nodes] == [n[0] for n in wrapper]:
        seen = dict(enumerate(range(len(nodes))))
    else:
        seen = {j: i for i, j in aligned(wrapper, nodes)}

    def at(index: int):
        return wrapper[seen[place[index]]] if place[index] in seen else None

    def wanted(index: int, path) -> bool:
        if aside(path, keep):
            return False
        if region is None:
            return in_article(path)
        node = at(index)
        fixed = node is not None and node[3] is not None and not node[1]  # on every page, and the same
        return list(path[:len(region)]) == region and (alone or not fixed)

    alone = all(n[3] is not None for n in wrapper if n[0] == "#")  # one page, or equal pages: nothing tells slots from fixed text
    chosen = {i for i, (key, _, path) in enumerate(tokens) if key == "#" and wanted(i, path)}
    if not chosen and region is not None:  # a page of another template: the region of its own slots
        own = [(i, ["#", False, False, None, list(path), len(text)]) for i, (key, text, path) in enumerate(tokens) if key == "#" and not aside(path, keep)]
        slots = [n for i, n in own if at(i) is None or at(i)[3] is None] or [n for i, n in own if at(i)[1]]
        region = deepest(slots)
        chosen = {i for i, n in own if slots and wanted(i, n[4])}
    elif not chosen and not any(in_article(t[2]) for t in tokens):  # the page has no article, unlike its host
        chosen = {i for i, (key, _, path) in enumerate(tokens) if key == "#" and not aside(path, keep)}
    blocks, now = [], []
    for i, (key, text, _) in enumerate(tokens):
        if key == "#":
            if i in chosen:
                now.append(html.unescape(text))
        elif key.lstrip("</").split(" ", 1)[0] not in INLINE:
            blocks.append("".join(now))
            now = []
        elif key == "<br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def inferred(pages: DataFrame) -> DataFrame:
    """(host, wrapper, region) from rows (host, html)."""

    def learn(batches):
        known: dict[str, list] = {}
        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = of_page(stream(page))[0]
                known[h] = merged(known[h], nodes) if h in known else nodes
            if len(known) > 2000:  # hand out and begin anew; merging joins the parts
                yield arrow_batch("host string, wrapper string", [list(known), [json.dumps(w) for w in known.values()]])
                known = {}
        yield arrow_batch("host string, wrapper string", [list(known), [json.dumps(w) for w in known.values()]])

    def merge(pdf):
        import pandas as pd

        out = None
        for w in sorted(pdf["wrapper"]):
            out = json.loads(w) if out is None else merged(out, json.loads(w))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(out)]})

    parts = written(pages.select("host", "html").mapInArrow(learn, "host string, wrapper string"), "wrapper-parts")
    salted = parts.withColumn("salt", F.pmod(F.hash("wrapper"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return written(some.groupBy("host").applyInPandas(merge, "host string, wrapper string"), "wrappers")


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """EXTRACTED for every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host(F.col(url_col)).alias("host"))
    found = inferred(rows.where("html <> ''"))
    both = rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for page, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if text is not None and text not in known:
                    if len(known) > 500:
                        known = {}
                    wrapper = json.loads(text)
                    known[text] = wrapper, main_path(wrapper), spared(wrapper)
                main = main_text(page, *known[text]) if page and text is not None else ""
                out.append((main, len(main)))
            yield arrow_batch(EXTRACTED, [batch.column(0), batch.column(1), *(zip(*out) if out else [[]] * 2)])

    return both.mapInArrow(run, EXTRACTED)
