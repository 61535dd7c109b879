"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive, by the element they stand in, tags negative, by name and
class; one linear scan finds the contiguous run with the largest sum. The weights are log-odds learnt from labelled
pages: those of a bounded sample that mark their one ``article`` or ``main`` element, whose words are content. The tokens of an
element's class and id score with its tag. What by its element (navigation, forms, ...) or a token of its class
or id is not the article has no words to score, also inside the run, unless it is a wrapper of the article: it holds
``main``, or most of the words of the page's ``article`` and ``main`` elements, or most of all words where there are none.

Results by case: null html is empty, and gives an empty text; pages without a positive run give an empty text; of equal runs
the first counts; an element that is never closed hides nothing, and a tag that never ends is text; without a labelled page
the prior weights hold; repeated pages are extracted alike; time and memory are linear in a page, however long.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripmill.llm.common import by_the_megabyte, hash_share

RAW = re.compile(r"<(script|style|textarea|title|noscript|template|iframe)\b", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
LONG_REFERENCE = re.compile(r"&#[0-9]{4000,};?")  # more digits than an int may be read from
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
# Element names of HTML, and names by which pages mark what is not the article.
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr del ins".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head nav footer aside form button select option dialog svg fieldset".split())
NEVER = set("head nav footer button select option svg".split())  # by words alone these wrap no article
OUTSIDE_ONLY = {"header", "menu"}
NOISE = set(
    "ad ads advert adverts advertisement advertising banner sidebar comment comments respond disqus cookie cookies consent notice notices "
    "alert menu nav navbar navigation footer promo promotion related share sharing social newsletter subscribe subscription "
    "popup modal breadcrumb breadcrumbs widget sponsor sponsored login signup search pagination pager toolbar skip".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
FRAME = {"html", "body", "article", "main"}
WORD_PRIOR, TAG_PRIOR, INNER_PRIOR, NOISE_PRIOR = 1.0, 1.0, 0.05, 2.0
WORD_RANGE, TAG_RANGE, MARK_RANGE = (0.05, 2.0), (0.02, 4.0), (0.0, 4.0)


def tag_ends(page: str):
    """Where the tag ends whose name ends at a place: the first ``>`` outside quotes, or -1. Worked out once for all places, from
    the end, so a tag that never ends costs no more than its own length."""
    spots = [(m.start(), m.group()) for m in re.finditer("[>\"']", page)]
    places = [at for at, _ in spots]
    ends, following = [-1] * (len(spots) + 1), {">": len(spots), '"': len(spots), "'": len(spots)}
    for i in range(len(spots) - 1, -1, -1):
        at, mark = spots[i]
        ends[i] = at if mark == ">" else ends[min(following[mark] + 1, len(spots))]
        following[mark] = i
    return lambda at: ends[bisect_left(places, at)]


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, rest): kind ``text``, ``open`` or ``close``; comments and raw elements are left out. Linear in the page."""
    found: list[tuple[str, str, str]] = []
    plain: list[str] = []
    end_of, last = tag_ends(page), page.rfind(">")
    closing: dict[str, re.Pattern] = {}
    at = 0

    def say() -> None:
        if plain:
            found.append(("text", "", "".join(plain)))
            plain.clear()

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            less = len(page)
        if less > at:
            plain.append(page[at:less])
            at = less
            continue
        if page.startswith("<!--", at):
            say()
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if at > last:  # no tag can end any more
            plain.append(page[at:])
            break
        raw = RAW.match(page, at)
        if raw:
            say()
            name = raw.group(1).lower()
            close = closing.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, page.find(">", at) + 1)
            at = close.end() if close else len(page)
            continue
        if page.startswith(("<!", "<?"), at):
            say()
            at = page.find(">", at) + 1
            continue
        tag = TAG.match(page, at)
        end = end_of(tag.end()) if tag else -1
        if end < 0:
            plain.append("<")
            at += 1
            continue
        say()
        found.append(("close" if tag.group(1) else "open", tag.group(2).lower(), page[tag.end() : end]))
        at = end + 1
    say()
    return found


def marks(attributes: str) -> tuple[set[str], set[str], set[str], bool]:
    """The words in class and in id, the class names as they are, and whether the element is hidden or has a role beside the
    article."""
    classes, ids, whole, out = set(), set(), set(), False
    if "=" in attributes or "hidden" in attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                (classes if key == "class" else ids).update(filter(None, re.split(r"[^a-z0-9]+", value)))
                whole.update(value.split() if key == "class" else ())
            elif key == "role":
                out |= value in NOISE_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                out = True
            elif key == "style":
                out |= "display:none" in value.replace(" ", "")
    return classes, ids, whole, out


def wrappers(found: list[tuple[str, str, str]], ends: dict[int, int]):
    """Whether the element that opens at a place is a wrapper of the article."""
    bounds = sorted((at, end) for at, end in ends.items() if found[at][1] in ("article", "main"))
    words, until, near = [0], -1, iter([*bounds, (len(found), len(found))])
    begin, end = next(near)
    plain = [0]
    for at, (kind, _, rest) in enumerate(found):
        while begin <= at:
            until = max(until, end)
            begin, end = next(near)
        n = len(rest.split()) if kind == "text" else 0
        plain.append(plain[-1] + n)
        words.append(words[-1] + n * (at < until))
    mains = [at for at, _ in bounds if found[at][1] == "main"]
    marked = words[-1] > 0

    def wraps(at: int) -> bool:
        last = ends[at]
        if bisect_right(mains, at) < bisect_left(mains, last):
            return True
        if not marked and found[at][1] in NEVER:
            return False
        held = words if marked else plain
        return 2 * (held[last] - held[at]) > held[-1]

    return wraps


def outline(page: str) -> list[tuple[str, str, str]]:
    """The page as (kind, key, text) with everything hidden taken out. Of words the key is the innermost element, of an
    opening tag its name and the tokens of its class and id, a space between. Inside a marked article ids are slugs and parts
    of class names are words: there an element goes only by a whole class name, and ids do not count."""
    found = tokens(page)
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for at, (kind, name, _) in enumerate(found):
        if kind == "open" and name not in VOID:
            opened.setdefault(name, []).append(at)
        elif kind == "close" and opened.get(name):
            ends[opened[name].pop()] = at
    made: list[tuple[str, str, str]] = []
    wraps = wrappers(found, ends)
    inside, path, skip = 0, [], -1
    depth: Counter[str] = Counter()
    for at, (kind, name, rest) in enumerate(found):
        if at <= skip:
            continue
        if kind == "text":
            made.append(("text", path[-1] if path else "", rest))
            continue
        key = name
        if kind == "open":
            names, ids, whole, out = marks(rest)
            names = whole if inside else names | ids
            noise = out or name in HIDDEN or bool(names & NOISE) or (name in OUTSIDE_ONLY and not inside)
            if noise and name not in FRAME and name not in VOID and at in ends and not wraps(at):
                skip = ends[at]
                made.append(("open", name, ""))
                continue
            key = " ".join([name, *sorted(names)])
            if at in ends and name not in INLINE:
                path.append(name)
                depth[name] += 1
                inside += name in ("article", "main")
        elif depth[name]:
            gone = ""
            while gone != name:
                gone = path.pop()
                depth[gone] -= 1
                inside -= gone in ("article", "main")
        made.append((kind, key, ""))
    return made


def named(key: str) -> str:
    return key.partition(" ")[0]


def learning_rows(page: str) -> dict[tuple[str, bool], int]:
    """How often each key occurs inside and outside the one marked element; nothing for pages that mark none or several."""
    made = outline(page)
    for mark in ("article", "main"):
        begins = [i for i, t in enumerate(made) if t[0] == "open" and named(t[1]) == mark]
        closes = [i for i, t in enumerate(made) if t[:2] == ("close", mark)]
        if len(begins) == len(closes) == 1 and begins[0] < closes[0]:
            count: dict[tuple[str, bool], int] = {}
            for i, (kind, key, text) in enumerate(made):
                n = len(text.split()) if kind == "text" else 1
                if n:
                    inside = begins[0] < i < closes[0]
                    for each in [f"{kind}:{named(key)}", *(f"mark:{token}" for token in key.split(" ")[1:])]:
                        count[each, inside] = count.get((each, inside), 0) + n
            return count
    return {}


def learn(pages: DataFrame, sample: int = 500) -> dict[str, float]:
    """Weights from about ``sample`` pages (a bound, by a hash of the id); counts per key reach the driver."""
    total = pages.count()
    chosen = pages.filter(hash_share("page_id") < min(1.0, sample / max(1, total))).select("html")

    def count(frames):
        for frame in frames:
            rows = [(key, inside, n) for page in frame["html"] for (key, inside), n in learning_rows(page or "").items()]
            yield pd.DataFrame(rows, columns=["key", "inside", "n"])

    counts = chosen.mapInPandas(count, "key string, inside boolean, n bigint").groupBy("key", "inside").agg(F.sum("n").alias("n"))
    seen: dict[str, list[int]] = {}
    for row in counts.collect():
        seen.setdefault(row["key"], [0, 0])[int(row["inside"])] = row["n"]
    weights = {}
    for key, (out, inner) in sorted(seen.items()):
        odds = float(np.log((inner + 1) / (out + 1)))
        bounds = MARK_RANGE if key.startswith("mark:") else TAG_RANGE
        weights[key] = float(np.clip(odds, *WORD_RANGE)) if key.startswith("text:") else -float(np.clip(-odds, *bounds))
    return weights


def weight(weights: dict[str, float], kind: str, key: str) -> float:
    key, *tokens = key.split(" ")
    if tokens:
        return weight(weights, kind, key) + sum(weights.get(f"mark:{token}", -NOISE_PRIOR * (token in NOISE)) for token in tokens)
    found = weights.get(f"{kind}:{key}")
    if found is not None:
        return found
    if kind == "text":
        return WORD_PRIOR
    return -(INNER_PRIOR if key in INLINE or key in ("p", "br", "h1", "h2", "h3", "h4") else TAG_PRIOR)


def extract(page: str, weights: dict[str, float]) -> str:
    made = outline(page)
    decoded = [html.unescape(LONG_REFERENCE.sub("\ufffd", text)) if kind == "text" else "" for kind, _, text in made]
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for at, (kind, key, _) in enumerate(made):
        total += weight(weights, kind, key) * (len(decoded[at].split()) if kind == "text" else 1)
        if total <= 0:
            total, begin = 0.0, at + 1
        elif total > best:
            best, best_at = total, (begin, at + 1)
    pieces = [
        decoded[at] if made[at][0] == "text" else ("" if named(made[at][1]) in INLINE and named(made[at][1]) != "wbr" else "\n")
        for at in range(*best_at)
    ]
    return " ".join("".join(pieces).split())


def extract_pages(pages: DataFrame, sample: int = 500) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; one pass, no shuffle."""
    weights = learn(pages, sample)

    def run(batches):
        for part in (part for batch in batches for part in by_the_megabyte(batch, "html")):
            texts = [extract(page or "", weights) for page in part.column("html").to_pylist()]
            sizes = pa.array([len(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
