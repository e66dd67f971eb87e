"""Main-text extraction by union-free regular expressions inferred for each host.

A page becomes a well-formed stream of block tags and text slots; inline markup is not part of it. Runs of equal token
sequences fold into repeated groups, which gives the page's skeleton. The skeletons of a host are aligned one after the
other: equal tokens and groups stay, a single occurrence of a group's body joins the group, other mismatches become
optional parts, and text slots remember whether their text is always the same. The result is the host's wrapper. Its
slots are content or not by where they stand and by whether their text changes from page to page: on hosts without an
article element any text that is always the same goes, inside an article one that stays the same while other text of the
article changes. Aligning a skeleton with its wrapper says which of its slots are content.

Work is per distinct skeleton, not per page, and a host's skeletons are first aligned in salted parts, so a host of very
many pages is no single task.

Defined results: null or empty html has empty text; a null url counts as a host of its own; pages cut off anywhere are
closed; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.store import keep
from viewloom.llm.worker import lean

#: Elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style template iframe svg textarea title noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog select button fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class, id and role words of what is not the article, and of page heads, which may be part of an article.
MARKED = frozenset("ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup signin login register comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations widget widgets search pagination pager skip copyright disclaimer complementary contentinfo form".split())
HEADS = frozenset("header masthead topbar toolbar banner".split())
#: Words that may stand beside those in a name; with any other word, as in share-price, a name says something else.
BESIDE = frozenset("left right top bottom site page global primary secondary wrap wrapper container box block area section inner outer list items item links buttons bar posts articles stories text unit slot zone module panel col column the js".split())
CONTENT = frozenset(("article", "main"))
#: Their ids are often made of their words.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: An opening tag ends open elements of these names, up to the container.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=[\"']))|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SLOT = "#"
#: Different pages on which a text is the same before that tells that it is none of theirs: without an article, and inside one.
SAME, SAME_INSIDE = 3, 5


def _key(name: str, attributes: str) -> str:
    """A tag's token: its name, and its classes, id and role, letters only."""
    words: set[str] = set()
    for attribute, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        value, attribute = value.strip("\"'").lower(), attribute.lower()
        if attribute in ("class", "id", "role"):
            words.update(w for w in (re.sub(r"[^a-z]+", "-", v).strip("-") for v in value.split()) if w)
        elif attribute == "hidden" or (attribute == "aria-hidden" and value == "true") or (attribute == "style" and re.search(r"display\s*:\s*none", value)):
            words.add("!hidden")
    return f"<{name}>" if not words else f"<{name} {' '.join(sorted(words))}>"


def stream(page: str) -> tuple[list[str], list[str]]:
    """A page's tokens, with SLOT for each block of text, and those texts."""
    tokens: list[str] = []
    texts: list[str] = []
    held: list[str] = []
    stack: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            tokens.append(SLOT)
            texts.append(text)

    def close(upto: int) -> None:
        flush()
        while len(stack) > upto:
            tokens.append(f"</{stack.pop()}>")

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                held.append(entities.unescape(m[0]))
            continue
        name = name.lower()
        if name in DROPPED:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if m[0][-1] != ">" and at >= size:
            break  # cut off within a tag
        if name == "br":
            held.append(" ")
        if name not in BLOCKS:
            continue
        if m[1]:
            if name in stack:
                close(len(stack) - 1 - stack[::-1].index(name))
            else:
                flush()
            continue
        flush()
        if stack and "p" in stack:
            close(len(stack) - 1 - stack[::-1].index("p"))
        if name in IMPLIED:
            ends, scope = IMPLIED[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in scope:
                    break
                if stack[i] in ends:
                    close(i)
        tokens.append(_key(name, m[3]))
        if name in VOID:
            continue
        stack.append(name)
    close(0)
    return tokens, texts


class _Node:
    """A token, or a repeated group: ``body`` is what repeats, ``rounds`` are its occurrences."""

    __slots__ = ("body", "key", "rounds")

    def __init__(self, key: str, body: list | None = None, rounds: list | None = None) -> None:
        self.key, self.body, self.rounds = key, body, rounds


def _shape(node: _Node):
    return ["+", *[_shape(n) for n in node.body]] if node.body else node.key


def _periods(keys: list[str]) -> list[int]:
    """Lengths of sequences that follow themselves somewhere, ascending."""
    last: dict[str, int] = {}
    ids, found = np.empty(len(keys), np.int64), set()
    names: dict[str, int] = {}
    for i, k in enumerate(keys):
        if k in last:
            found.add(i - last[k])
        last[k] = i
        ids[i] = names.setdefault(k, len(names))
    out = []
    for n in sorted(x for x in found if 2 * x <= len(keys)):
        same = np.concatenate([[False], ids[:-n] == ids[n:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        if len(edges) and (edges[1::2] - edges[::2]).max() >= n:
            out.append(n)
    return out


def fold(tokens: list[str]) -> tuple[list, list[int]]:
    """The skeleton of a stream (tokens and ["+", body...] groups), and the skeleton's slot for each SLOT of the stream."""
    nodes = [_Node(t) for t in tokens]
    changed = True
    while changed:
        changed = False
        for n in _periods([x.key for x in nodes]):
            keys = [x.key for x in nodes]
            out: list[_Node] = []
            i = 0
            while i < len(nodes):
                j = i + n
                while j + n <= len(nodes) and keys[j] == keys[i] and keys[j : j + n] == keys[i : i + n]:
                    j += n
                if j > i + n:
                    rounds = [r for at in range(i, j, n) for r in (nodes[at].rounds if n == 1 and nodes[at].body else [nodes[at : at + n]])]
                    body = nodes[i].body if n == 1 and nodes[i].body else nodes[i : i + n]
                    out.append(_Node("(" + "".join(x.key for x in body) + ")+", body, rounds))
                    i = j
                    changed = True
                else:
                    out.append(nodes[i])
                    i += 1
            nodes = out
    slots: list[int] = []

    def number(seq: list[_Node], first: int) -> int:
        for x in seq:
            if x.body:
                # slots are met in stream order, round by round, and each round has the body's numbers
                after = first
                for r in x.rounds:
                    after = number(r, first)
                first = after
            elif x.key == SLOT:
                slots.append(first)
                first += 1
        return first

    number(nodes, 0)
    return [_shape(x) for x in nodes], slots


def n_slots(item) -> int:
    return (item == SLOT) if isinstance(item, str) else sum(map(n_slots, item[1:]))


def name_of(item) -> str:
    return item if isinstance(item, str) else "(" + "".join(map(name_of, item[1:])) + ")+"


def located(items: list) -> list[str]:
    """The items' names with the open elements they stand in; only items in the same place are alike."""
    out: list[str] = []
    path: list[str] = []
    for x in items:
        out.append("/".join(path) + " " + name_of(x))
        if isinstance(x, str) and x != SLOT:
            if not x.startswith("</"):
                if x[1:-1].partition(" ")[0] not in VOID:
                    path.append(x[1:-1])
            elif any(p.partition(" ")[0] == x[2:-1] for p in path):
                while path.pop().partition(" ")[0] != x[2:-1]:
                    pass
    return out


def grouped(items: list[dict], groups: list[list]) -> list[dict]:
    """Single occurrences of a group's body join it. items: {item, texts: what is known of each slot's, pages: distinct pages that have it}."""
    for g in groups:
        body = [name_of(x) for x in g[1:]]
        names = [name_of(x["item"]) for x in items]
        i = 0
        while i + len(body) <= len(items):
            if names[i] == body[0] and names[i : i + len(body)] == body:
                part = items[i : i + len(body)]
                items = [*items[:i], {"item": g, "texts": [t for p in part for t in p["texts"]], "pages": max(p["pages"] for p in part)}, *items[i + len(body) :]]
                names = [*names[:i], name_of(g), *names[i + len(body) :]]
            i += 1
    return items


def _groups(items: list[dict]) -> list[list]:
    found = {name_of(x["item"]): x["item"] for x in items if not isinstance(x["item"], str)}
    return sorted(found.values(), key=lambda g: (-len(name_of(g)), name_of(g)))


#: In place of a slot's text: it changes from page to page, or is not known, as in a repeated group.
VARIES, UNKNOWN = "~", ""


def _common(a: str, b: str) -> str:
    return a if a == b else UNKNOWN if UNKNOWN in (a, b) and VARIES not in (a, b) else VARIES


def align(wrapper: list[dict], other: list[dict]) -> list[dict]:
    """The wrapper of both: shared parts once, the rest optional (in fewer pages); a slot's text varies if they differ."""
    if not wrapper or not other:
        return wrapper or other
    wrapper, other = grouped(wrapper, _groups(other)), grouped(other, _groups(wrapper))
    a, b = located([x["item"] for x in wrapper]), located([x["item"] for x in other])
    out: list[dict] = []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[i:j], other[k:m], strict=True):
                texts = [_common(t, u) for t, u in zip(x["texts"], y["texts"], strict=True)]
                out.append({"item": x["item"], "texts": texts, "pages": x["pages"] + y["pages"]})
        else:
            out += wrapper[i:j] + other[k:m]
    return out


def start(skeleton: list, texts: list, pages: int = 1) -> list[dict]:
    """A wrapper of one skeleton, of so many distinct pages; texts: for each slot the hash of its text if that is always the same, or VARIES or UNKNOWN."""
    out, at = [], 0
    for item in skeleton:
        n = n_slots(item)
        out.append({"item": item, "texts": texts[at : at + n], "pages": pages})
        at += n
    return out


def _marked(names: frozenset[str], words: frozenset[str]) -> bool:
    """Whether a name is one of ``words``, or made of them and of words that may stand beside them."""
    for name in names:
        parts = set(name.split("-"))
        if parts & words and parts <= MARKED | HEADS | BESIDE:
            return True
    return False


def _excluded(tag: str, inside: bool) -> bool:
    name, _, words = tag[1:-1].partition(" ")
    marks = frozenset(words.split())
    if name in OUTSIDE or "!hidden" in marks:
        return True
    if name in ("html", "body", *CONTENT) or (inside and name in TEXTS):
        return False
    return _marked(marks, MARKED - HEADS if inside else MARKED) or (not inside and (name == "header" or _marked(marks, HEADS)))


def _never(tag: str) -> bool:
    return tag[1:-1].partition(" ")[0] in (*OUTSIDE, "header") or "!hidden" in tag[1:-1].split()


def _headed(items: list) -> list[bool]:
    """For each slot whether it is in a heading."""
    found: list[bool] = []
    within = 0

    def walk(seq: list) -> None:
        nonlocal within
        for x in seq:
            if not isinstance(x, str):
                walk(x[1:])
            elif x == SLOT:
                found.append(within > 0)
            elif x.strip("</>").partition(" ")[0] in HEADINGS:
                within = max(0, within + (-1 if x.startswith("</") else 1))

    walk(items)
    return found


def slot_places(items: list, reset: bool = False) -> list[tuple[bool, bool]]:
    """For each slot of a wrapper or skeleton whether it is inside an article, and whether it is outside the main text.

    With ``reset`` an article or main element below elements that only their words put outside, such as a layout named for
    its sidebar, is not outside.
    """
    found: list[tuple[bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []

    def walk(seq: list) -> None:
        for x in seq:
            if not isinstance(x, str):
                walk(x[1:])
            elif x == SLOT:
                found.append((stack[-1][1], stack[-1][2]) if stack else (False, False))
            elif x.startswith("</"):
                name = x[2:-1]
                while stack and any(s[0] == name for s in stack):
                    if stack.pop()[0] == name:
                        break
            else:
                name = x[1:-1].partition(" ")[0]
                inside, out, never = stack[-1][1:] if stack else (False, False, False)
                never = never or _never(x)
                out = out and not (reset and name in CONTENT and not never)
                words = x[1:-1].partition(" ")[2].split()
                here = inside or name in CONTENT or (name in ("div", "section") and bool(CONTENT & set(words)) and not _excluded(x, False))
                if name not in VOID:
                    stack.append((name, here, out or _excluded(x, inside), never))

    walk(items)
    return found


def mask(wrapper: list[dict], skeleton: list) -> str:
    """For each slot of a skeleton, 1 if the wrapper's slot is content.

    Where there is no article element, a slot whose text is the same in ``SAME`` different pages is not content; inside an
    article one whose text is the same in ``SAME_INSIDE`` pages, if it is no heading and the text of another slot that is no
    heading changes there: copies of one article keep it. A slot that finds no place in the wrapper goes by its own place in the page. If all articles are outside by words of elements
    above them, and have more slots than are left without them, those words don't count for them.
    """
    flat = [x["item"] for x in wrapper]
    told = [t for x in wrapper for t in x["texts"]]
    same = [x["pages"] if t not in (VARIES, UNKNOWN) else 0 for x in wrapper for t in x["texts"]]
    headed = _headed(flat)
    mine = grouped(start(skeleton, list(range(len(slot_places(skeleton))))), _groups(wrapper))
    starts = [0]
    for x in flat:
        starts.append(starts[-1] + n_slots(x))
    blocks = SequenceMatcher(None, located(flat), located([x["item"] for x in mine]), autojunk=False).get_matching_blocks()

    def marked(reset: bool) -> tuple[bool, str]:
        found = slot_places(flat, reset)
        varies = any(inside and not out and t == VARIES and not h for (inside, out), t, h in zip(found, told, headed, strict=True))
        places = [(inside, out, n >= SAME, varies and n >= SAME_INSIDE and not h) for (inside, out), n, h in zip(found, same, headed, strict=True)]
        own = [(*p, False, False) for p in slot_places(skeleton, reset)]
        article = any(inside and not out for inside, out, _, _ in own)
        for i, k, n in blocks:
            for d in range(n):
                for e, slot in enumerate(mine[k + d]["texts"]):
                    own[slot] = places[starts[i + d] + e]
        return article, "".join("1" if not out and (inside and not still if article else not fixed) else "0" for inside, out, fixed, still in own)

    article, strict = marked(False)
    if article:
        return strict
    article, relaxed = marked(True)
    return relaxed if article and relaxed.count("1") > strict.count("1") else strict


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """page_id, url, host, skeleton, print (its hash), slots and texts (by block), hash of the page, and slots of one text with its hash."""
    names = ["page_id", "url", "host", "skeleton", "print", "slots", "texts", "page", "single", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for value in batch.column(2):
                value = value.as_py() or ""
                tokens, texts = stream(value)
                skeleton, slots = fold(tokens)
                name = json.dumps(skeleton, ensure_ascii=False, separators=(",", ":"))
                times = Counter(slots)
                once = [(k, _hash(t)) for k, t in zip(slots, texts, strict=True) if times[k] == 1]
                for c, x in zip(cols, (name, _hash(name), slots, texts, _hash(value), [k for k, _ in once], [h for _, h in once]), strict=True):
                    c.append(x)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = lean(pages).select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    return rows.mapInArrow(run, "page_id long, url string, host string, skeleton string, print long, slots array<int>, texts array<string>, page long, single array<int>, hashes array<long>")


def wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host and wrapper from the rows of ``parsed``."""
    single = pages.select("host", "print", F.explode(F.arrays_zip("single", "hashes")).alias("x"))
    fixed = single.groupBy("host", "print", F.col("x.single").alias("slot")).agg(F.min("x.hashes").alias("lo"), F.max("x.hashes").alias("hi"))
    fixed = fixed.groupBy("host", "print").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.lit(VARIES))))).alias("fixed"))
    kinds = pages.groupBy("host", "print").agg(F.min("skeleton").alias("skeleton"), F.count("*").alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.approx_count_distinct("page").alias("pages"))
    rows = kinds.join(fixed, ["host", "print"], "left")
    rows = rows.select("host", "print", "skeleton", "fixed", F.when(F.col("lo") == F.col("hi"), 1).when(F.col("pages") < 2, 2).otherwise(F.col("pages")).cast("long").alias("pages"), "n", F.pmod("print", F.lit(salts)).alias("salt"))

    def merge(read) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, made = None, []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([json.dumps(made)], pa.string())], ["host", "salt", "wrapper"])

            for batch in batches:
                for row in batch.to_pylist():
                    if now != (row["host"], row["salt"]):
                        if now:
                            yield out()
                        now, made = (row["host"], row["salt"]), []
                    made = align(made, read(row))
            if now:
                yield out()

        return run

    def first(row: dict) -> list[dict]:
        skeleton, known = json.loads(row["skeleton"]), dict(row["fixed"] or [])
        return start(skeleton, [known.get(i, UNKNOWN) for i in range(sum(map(n_slots, skeleton)))], row["pages"])

    schema = "host string, salt long, wrapper string"
    parts = rows.repartition("host", "salt").sortWithinPartitions("host", "salt", F.desc("n"), "print").mapInArrow(merge(first), schema)
    parts = parts.select("host", F.lit(0).cast("long").alias("salt"), "wrapper", F.col("salt").alias("part"))
    whole = parts.repartition("host").sortWithinPartitions("host", "part").mapInArrow(merge(lambda row: json.loads(row["wrapper"])), schema)
    return whole.select("host", "wrapper")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by two line ends) and n_chars for each row."""
    rows = keep(parsed(pages, key, url, html), "pages")
    skeletons = rows.groupBy("host", "print").agg(F.min("skeleton").alias("skeleton"))
    made = keep(wrappers(rows), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [mask(json.loads(r["wrapper"]), json.loads(r["skeleton"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], ["host", "print", "mask"])

    masks = keep(skeletons.join(made, "host").select("host", "print", "skeleton", "wrapper").mapInArrow(run, "host string, print long, mask string"), "masks")
    told = rows.join(masks, ["host", "print"])
    good = F.filter(F.arrays_zip("slots", "texts"), lambda x: F.substring(F.col("mask"), x["slots"] + 1, F.lit(1)) == "1")
    out = told.select("page_id", "url", F.array_join(F.transform(good, lambda x: x["texts"]), "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
